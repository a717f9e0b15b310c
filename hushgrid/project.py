"""Setting up a project: its kinds, a configuration to begin with, and a hook before commits."""

from __future__ import annotations

import os
import stat
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.suppress import write_whole
from .sources import config

#: Kind: (marker files, globs to exclude).
KINDS = {
    "rust": (("Cargo.toml",), ("target/",)),
    "node": (("package.json",), ("node_modules/", "dist/", "build/")),
    "python": (("pyproject.toml", "setup.py", "requirements.txt"), ("__pycache__/", ".venv/", "venv/")),
    "go": (("go.mod",), ("vendor/",)),
    "ruby": (("Gemfile",), ("vendor/bundle/",)),
    "php": (("composer.json",), ("vendor/",)),
    "jvm": (("pom.xml", "build.gradle", "build.gradle.kts"), ("target/", "build/", ".gradle/")),
    "dotnet": (("global.json", "Directory.Build.props"), ("bin/", "obj/")),
}
HOOK_MARK = "# hushgrid hook"
HOOK = f"#!/bin/sh\n{HOOK_MARK}\nexec python -m hushgrid scan --staged\n"


def detected(names: list[str]) -> list[str]:
    """The kinds of a project by the names in its root."""
    return sorted(k for k, (marks, _) in KINDS.items() if any(m in names for m in marks))


def exclude_paths(kinds: list[str]) -> list[str]:
    return sorted({g for k in kinds for g in KINDS[k][1]})


def projects(paths: DataFrame) -> DataFrame:
    """(root, kind, excludes) of the folders of a table of paths that hold a marker file."""
    marks = paths.sparkSession.createDataFrame([(m, k, sorted(g)) for k, (ms, g) in KINDS.items() for m in ms], "mark string, kind string, globs array<string>")
    named = paths.select(F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias("root"), F.regexp_extract("path", r"[^/]*$", 0).alias("mark"))
    return named.join(F.broadcast(marks), "mark").groupBy("root").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("globs")))).alias("excludes"))


def init(folder: str = ".", minimal: bool = False, output: str = ".hushgrid.toml") -> str:
    """Write a configuration; the path is returned. An existing file is an error."""
    path = os.path.join(folder, output)
    if os.path.exists(path):
        raise FileExistsError(path)
    text = config.minimal()
    if not minimal:
        globs = exclude_paths(detected(os.listdir(folder)))
        text += config.dump(config.Config(exclude_paths=globs)) if globs else ""
        text += '\n# minimum_confidence = "high"\n# disabled_patterns = []\n# baseline_path = ".hushgrid-baseline.json"\n\n# [[patterns]]\n# id = "custom/own-key"\n# name = "Own key"\n# severity = "high"\n# regex = \'OWN_[A-Z0-9]{16}\'\n# keywords = ["OWN_"]\n'
    write_whole(path, text)
    return path


def hook_path(repo: str) -> Path:
    return Path(repo, ".git", "hooks", "pre-commit")


def hook_status(repo: str) -> str:
    """none, installed, or foreign."""
    p = hook_path(repo)
    return "none" if not p.exists() else "installed" if HOOK_MARK in p.read_text(errors="replace") else "foreign"


def hook_install(repo: str) -> None:
    if hook_status(repo) == "foreign":
        raise FileExistsError(f"{hook_path(repo)} is someone else's")
    hook_path(repo).parent.mkdir(parents=True, exist_ok=True)
    write_whole(str(hook_path(repo)), HOOK)
    hook_path(repo).chmod(hook_path(repo).stat().st_mode | stat.S_IXUSR | stat.S_IXGRP | stat.S_IXOTH)


def hook_uninstall(repo: str) -> bool:
    if hook_status(repo) != "installed":
        return False
    hook_path(repo).unlink()
    return True
