"""The command line: scan, fix, history, baseline, patterns, init, hook. Exit code 1: findings, 2: an error."""

from __future__ import annotations

import argparse
import itertools
import json
import sys
import textwrap
import time
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from . import project, ship
from .catalogue import PatternError, Registry
from .operators import fix, report
from .operators import suppress as sup
from .operators.scan import context_lines, raw_findings
from .operators.verify import verification_counts, verifiers
from .plans import commands
from .sources import config as conf
from .sources import files as src
from .sources import git
from .sources.globs import excluded


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("hushgrid")
    sub = p.add_subparsers(dest="command", required=True)
    every = argparse.ArgumentParser(add_help=False)
    every.add_argument("--config", default=".hushgrid.toml")
    every.add_argument("--severity")
    every.add_argument("--exclude", action="append", default=[])
    every.add_argument("--max-file-size", type=int)
    shown = argparse.ArgumentParser(add_help=False)
    shown.add_argument("--format", choices=("text", "json", "sarif"), default="text")
    shown.add_argument("--output")
    shown.add_argument("--minimum-confidence", choices=("low", "high"))
    shown.add_argument("--exit-zero", action="store_true")
    shown.add_argument("--verbose", action="store_true")
    shown.add_argument("--concurrency", type=int)
    s = sub.add_parser("scan", aliases=["s"], parents=[every, shown])
    s.add_argument("paths", nargs="*", default=["."])
    s.add_argument("--skip-gitignore", action="store_true")
    s.add_argument("--staged", action="store_true")
    s.add_argument("--baseline")
    s.add_argument("--allow-new", action="store_true")
    s.add_argument("--verify", action="store_true")
    f = sub.add_parser("fix", aliases=["f"], parents=[every])
    f.add_argument("paths", nargs="*", default=["."])
    f.add_argument("--action", choices=fix.ACTIONS, default="redact")
    f.add_argument("--skip-gitignore", action="store_true")
    f.add_argument("--dry-run", action="store_true")
    h = sub.add_parser("history", aliases=["h"], parents=[every, shown])
    h.add_argument("--limit", type=int)
    h.add_argument("--since")
    h.add_argument("--until")
    h.add_argument("--branch")
    h.add_argument("--first-parent", action="store_true")
    h.add_argument("--all", action="store_true")
    b = sub.add_parser("baseline", aliases=["b"], parents=[every])
    b.add_argument("paths", nargs="*", default=["."])
    b.add_argument("--output", default=".hushgrid-baseline.json")
    b.add_argument("--status", choices=sup.STATUSES, default="accepted")
    b.add_argument("--reason")
    b.add_argument("--stats", action="store_true")
    b.add_argument("--json", action="store_true")
    b.add_argument("--accept-all", action="store_true")
    b.add_argument("--minimum-confidence", choices=("low", "high"))
    q = sub.add_parser("patterns", aliases=["p"])
    q.add_argument("--group")
    q.add_argument("--severity")
    q.add_argument("--verbose", action="store_true")
    i = sub.add_parser("init")
    i.add_argument("--minimal", action="store_true")
    i.add_argument("--yes", action="store_true")
    i.add_argument("--output", default=".hushgrid.toml")
    k = sub.add_parser("hook")
    k.add_argument("do", choices=("install", "uninstall", "status"))
    return p


def session(concurrency: int | None) -> SparkSession:
    b = SparkSession.builder.appName("hushgrid").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    return ship((b.master(f"local[{concurrency}]") if concurrency else b).getOrCreate())


def _emit(pieces: Iterable[str], output: str | None) -> None:
    """The pieces of a report and a line feed, as they come."""
    if output:
        sup.write_whole(output, "".join(pieces) + "\n")
        return
    for x in pieces:
        sys.stdout.write(x)
    sys.stdout.write("\n")


def _files(spark: SparkSession, a: argparse.Namespace, c: conf.Config) -> DataFrame:
    size = a.max_file_size or c.max_file_size or src.MAX_FILE_SIZE
    if getattr(a, "staged", False):
        return git.staged(spark, ".")
    return src.read(spark, a.paths, [*c.exclude_paths, *a.exclude], not getattr(a, "skip_gitignore", False), size)


def run(a: argparse.Namespace) -> int:
    began = time.monotonic()
    command = {"s": "scan", "f": "fix", "h": "history", "b": "baseline", "p": "patterns"}.get(a.command, a.command)
    if command == "init":
        print(project.init(".", a.minimal, a.output))
        return 0
    if command == "hook":
        if a.do == "install":
            project.hook_install(".")
        elif a.do == "uninstall":
            project.hook_uninstall(".")
        print(project.hook_status("."))
        return 0
    spark = session(getattr(a, "concurrency", None))
    if command == "patterns":
        for r in report.pattern_list(Registry().table(spark), a.group, a.severity).orderBy("group", "ordinal").collect():
            print(f"{r.severity:9}{r.pattern_id:45}{r.name}")
            if a.verbose:
                for x in textwrap.wrap(r.description, 72, break_long_words=False, break_on_hyphens=False) + [f"keywords: {', '.join(r.keywords)}", f"regex: {r.regex}"]:
                    print(f"    {x}")
        return 0
    c = conf.load(a.config).check(spark)
    if command == "scan":
        done = commands.run_scan(_files(spark, a, c), c, a.severity, a.minimum_confidence, a.baseline)
        shown = done.shown.cache()  # the report, the counts and the exit code read it
        checked = None
        if a.verify:
            raw = raw_findings(_files(spark, a, c), commands.options(c, a.severity))
            checked = commands.run_verification(raw, shown, verifiers(), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")).cache()
        if a.format == "sarif":
            out = report.pieces(report.scan_sarif(shown, c.registry()))
        elif a.format == "json":
            rows = report.scan_json(shown, checked).orderBy("path", "byte_start").select("json").toLocalIterator()
            out = itertools.chain(("[",), ((",\n" if k else "") + r[0] for k, r in enumerate(rows)), ("]",))
        else:
            n = {r[0]: r[1] for r in report.severity_counts(shown).collect()}
            frames = context_lines(_files(spark, a, c), commands.options(c, a.severity))
            rows = report.text_lines(shown, frames, checked).orderBy("path", "byte_start").select("text").toLocalIterator()
            tail = [f"{sum(n.values())} secrets" + "".join(f", {v} {k}" for k, v in sorted(n.items()))]
            tail += [str(verification_counts(shown, checked).first().asDict())] if checked is not None else []
            tail += [str(done.stats().first().asDict())] if a.verbose else []
            out = itertools.chain((r[0] + "\n" for r in rows), ("\n".join(tail),))
        _emit(out, a.output)
        return report.exit_code(shown, a.exit_zero, a.allow_new)
    if command == "fix":
        found = _files(spark, a, c)
        changed = fix.fixed(found, a.action, commands.options(c, a.severity))
        for r in changed.orderBy("path").toLocalIterator():
            if not a.dry_run:
                sup.write_whole(r.path, r.content)
            print(f"{r.path}: {r.n_edits} edits")
        return 0
    if command == "history":
        walked = git.commits(spark, ".", a.limit, a.since, a.until, a.branch, a.first_parent)
        blobs = git.changed_blobs(spark, ".", walked, a.max_file_size or c.max_file_size or src.MAX_FILE_SIZE)
        blobs = blobs.where(~excluded(blobs["path"], [*c.exclude_paths, *a.exclude], "history"))
        found = commands.run_history(walked, blobs, c, a.severity, a.minimum_confidence, a.all).cache()
        if a.format == "sarif":
            out = report.pieces(report.history_sarif(found, c.registry()))
        elif a.format == "json":
            out = report.pieces(report.history_json(found, {"commits_scanned": walked.count(), "duration_ms": int(1000 * (time.monotonic() - began))}))
        else:
            rows = report.history_text(found).orderBy("introduced_at", "pattern_id", "id").toLocalIterator()
            out = itertools.chain((r.text + "\n\n" for r in rows), (f"{found.count()} secrets in {walked.count()} commits",))
        _emit(out, a.output)
        return int(not a.exit_zero and bool(found.head(1)))
    known = sup.load(spark, a.output) if _exists(a.output) else spark.createDataFrame([], sup.BASELINE)
    if a.stats and a.json:
        print(json.dumps([r.asDict() for r in sup.stats(known).orderBy("kind", "name").collect()]))
        return 0
    if a.stats:
        for r in sup.stats(known).orderBy("kind", "name").collect():
            print(f"{r.kind:10}{r.name:12}{r.n:8}{r.percent:5} %")
        return 0
    now = int(time.time())
    sup.save(commands.accept(_files(spark, a, c), c, known, "accepted" if a.accept_all else a.status, a.reason, now, a.severity, a.minimum_confidence), a.output, now)
    return 0


def _exists(path: str) -> bool:
    try:
        open(path).close()
    except FileNotFoundError:
        return False
    return True


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except (sup.BaselineError, conf.ConfigError, PatternError, git.GitError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
