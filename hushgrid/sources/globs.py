"""Globs as native predicates on paths, in three dialects, and ignore files with their last-match-wins rule."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str, star_crosses: bool = False) -> str:
    """The body of a regex for a glob. Without ``star_crosses`` a star stays within a path segment."""
    any_one, any_many = (".", ".*") if star_crosses else ("[^/]", "[^/]*")
    out, i, n = [], 0, len(glob)
    while i < n:
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append(any_many)
        elif c == "?":
            out.append(any_one)
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif c == "{" and (end := glob.find("}", i)) > 0:
            out.append("(?:" + "|".join(glob_regex(x, star_crosses) for x in glob[i + 1 : end].split(",")) + ")")
            i = end
        elif c == "\\" and i + 1 < n:
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def _rules(lines: Iterable[str], base: str = "") -> list[tuple[str, bool, bool]]:
    """(regex, negated, directories only) of the lines of an ignore file that lies in the folder ``base``."""
    out = []
    for raw in lines:
        line = raw.rstrip("\r\n")
        if not line.strip() or line.startswith("#"):
            continue
        line = line.rstrip() if not line.endswith("\\ ") else line[:-2] + " "
        negated = line.startswith("!")
        body = line[negated:].removeprefix("\\") if line[negated:].startswith(("\\#", "\\!")) else line[negated:]
        folder = body.endswith("/")
        body = body.rstrip("/")
        if not body:
            continue
        anchored = "/" in body
        regex = glob_regex(body.lstrip("/"))
        out.append((f"^{re.escape(base + '/') if base else ''}{'' if anchored else '(?:.*/)?'}{regex}$", negated, folder))
    return out


def ignored(path: Column, files: Iterable[tuple[str, Iterable[str]]]) -> Column:
    """Whether a path, relative to the root, is ignored by ignore files (folder, lines), outer ones first. The last rule that matches wins;
    what lies in an ignored folder can't be taken back."""
    rules = [r for base, lines in files for r in _rules(lines, base)]
    if not rules:
        return F.lit(False)

    def decided(p: Column, is_folder: Column) -> Column:
        return reduce(lambda rest, r: F.when(p.rlike(r[0]) & (is_folder if r[2] else F.lit(True)), F.lit(not r[1])).otherwise(rest), rules, F.lit(False))

    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("p"), (k < F.size(parts)).alias("d")))
    return F.exists(prefixes, lambda x: decided(x["p"], x["d"]))


def excluded(path: Column, globs: Iterable[str], mode: str = "scan", root: str = "") -> Column:
    """Whether a path matches one of the exclude globs. Modes: ``scan`` (as in an ignore file), ``history`` (over the whole path, a star
    crosses folders), ``editor`` (the whole path, absolute or relative to the root; a leading slash is the root, others match at any depth; a star crosses
    folders, and a folder's name alone excludes nothing: write ``out/**``)."""
    globs = [g for g in globs if g]
    if mode == "scan":
        return ignored(path, [("", globs)])
    if mode == "history":
        rx = [f"(?s)^{glob_regex(g, True)}$" for g in globs]
    elif mode == "editor":
        rx = ["(?s)^" + (re.escape(root.rstrip("/")) + glob_regex(g, True) if g.startswith("/") else glob_regex("**/" + g, True)) + "$" for g in globs]
    else:
        raise ValueError(f"unknown dialect: {mode}")
    return reduce(lambda a, b: a | b, [path.rlike(x) for x in rx], F.lit(False))
