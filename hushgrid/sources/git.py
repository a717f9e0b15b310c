"""Repositories as tables. Commits and names are listed by the git command on the driver; contents are read by the tasks, so the
repository's folder must be one that all executors see."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

COMMIT = "hash string, short_hash string, parent string, author_name string, author_email string, date timestamp, message string, place long"
BLOB = "hash string, path string, content string"
_NO_PARENT = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"  # the empty tree


class GitError(RuntimeError):
    """What git said when it failed."""


def _git(repo: str, *args: str, text: bool = True, stdin: bytes | None = None) -> str | bytes:
    p = subprocess.run(["git", "-C", repo, *args], capture_output=True, input=stdin)
    if p.returncode:
        raise GitError(p.stderr.decode(errors="replace").strip())
    return p.stdout.decode(errors="replace") if text else p.stdout


def tips(repo: str, branch: str | None = None, until: str | None = None) -> list[str]:
    """Where a walk starts: at ``until`` if it names a commit, at the branch, or at all local branches; at HEAD if there is none."""
    if until and until != "HEAD" and not _day(until) and not _moment(until):
        return [until]
    if branch:
        return [branch]
    return [x for x in _git(repo, "for-each-ref", "--format=%(refname)", "refs/heads").splitlines() if x] or ["HEAD"]


def _day(s: str) -> datetime | None:
    try:
        return datetime.strptime(s, "%Y-%m-%d")
    except ValueError:
        return None


def _moment(s: str) -> datetime | None:
    """A date with a time, as RFC 3339 writes it; without a zone it is UTC."""
    try:
        d = datetime.fromisoformat(s) if "T" in s or " " in s else None
    except ValueError:
        return None
    return d and (d if d.tzinfo else d.replace(tzinfo=UTC))


def commits(spark: SparkSession, repo: str, limit: int | None = None, since: str | None = None, until: str | None = None, branch: str | None = None, first_parent: bool = False) -> DataFrame:
    """Commits, newest first (``place`` is the place in the walk). A commit named by ``since`` ends the walk and isn't in it; a name that
    isn't known is left out of account. Days are whole."""
    args = ["log", "--date-order", "--format=%H%x00%P%x00%an%x00%ae%x00%ct%x00%s%x1e"]
    args += ["--first-parent"] if first_parent else []
    if until and (_day(until) or _moment(until)):
        args.append(f"--before={until} 23:59:59" if _day(until) else f"--before={_moment(until).isoformat()}")
    if since and (_day(since) or _moment(since)):
        args.append(f"--after={since} 23:59:59" if _day(since) else f"--after={_moment(since).isoformat()}")
    elif since:
        try:
            args.append("^" + _git(repo, "rev-parse", "--verify", since + "^{commit}").strip())
        except GitError:
            pass
    args += [f"-n{limit}"] if limit is not None else []
    rows = []
    for k, r in enumerate(x.strip("\n") for x in _git(repo, *args, *tips(repo, branch, until), "--").split("\x1e") if x.strip("\n")):
        h, parents, name, mail, at, message = r.split("\0")
        rows.append((h, h[:7], parents.split(" ")[0] or None, name, mail, datetime.fromtimestamp(int(at), UTC), message, k))
    return spark.createDataFrame(rows, COMMIT)


def changed_blobs(spark: SparkSession, repo: str, hashes: DataFrame, max_size: int | None = 1 << 20) -> DataFrame:
    """(hash, path, content) of what each commit (hash, parent) adds or alters against its first parent: text of at most so many bytes.

    One git process names the blobs; their contents are read where the tasks run, from the same folder, by one process a task."""
    asked = "".join(f"{h} {parent or ''}".rstrip() + "\n" for h, parent in hashes.select("hash", "parent").toLocalIterator())
    out = _git(repo, "diff-tree", "--stdin", "--root", "-r", "-z", "--diff-filter=d", "--no-renames", stdin=asked.encode())
    rows, commit, parts = [], None, iter(out.split("\0"))
    for x in parts:
        if x.startswith(":"):
            rows.append((commit, next(parts), x.split()[3]))
        elif x.strip():
            commit = x.strip().split()[0]
    return blob_texts(spark.createDataFrame(rows, "hash string, path string, blob string"), repo, max_size)


def staged(spark: SparkSession, repo: str) -> DataFrame:
    """(path, content) of the entries of the index that differ from HEAD; all of them without a HEAD."""
    try:
        head = _git(repo, "rev-parse", "--verify", "HEAD").strip()
    except GitError:
        head = _NO_PARENT
    diff = _git(repo, "diff-index", "--cached", "-z", "--diff-filter=d", "--no-renames", head).split("\0")
    rows = [("", path, meta.split()[3]) for meta, path in zip(diff[::2], diff[1::2], strict=False)]
    return blob_texts(spark.createDataFrame(rows, "hash string, path string, blob string"), repo, None).select("path", "content")


def blob_texts(blobs: DataFrame, repo: str, max_size: int | None) -> DataFrame:
    """(hash, path, content) of blobs (hash, path, blob) that are text and small enough."""
    folder = os.path.abspath(repo)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen(["git", "-C", folder, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
            for batch in batches:
                for h, path, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    p.stdin.write(blob.encode() + b"\n")
                    p.stdin.flush()
                    about = p.stdout.readline().split()
                    if len(about) < 3 or about[1] != b"blob":  # a submodule's commit, or gone
                        if len(about) == 3 and about[2].isdigit():
                            p.stdout.read(int(about[2]) + 1)
                        continue
                    raw = p.stdout.read(int(about[2]))
                    p.stdout.read(1)
                    if (text := _text(raw, max_size)) is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([path]), pa.array([text])], names=["hash", "path", "content"])
            p.stdin.close()

    return blobs.mapInArrow(read, BLOB)


def head_texts(spark: SparkSession, repo: str, paths: list[str]) -> DataFrame:
    """(path, head_content) of the files as they are at HEAD; null where they aren't there."""
    rows = []
    for p in paths:
        try:
            rows.append((p, _git(repo, "show", f"HEAD:{p}", text=False).decode()))
        except (GitError, UnicodeDecodeError):
            rows.append((p, None))
    return spark.createDataFrame(rows, "path string, head_content string")


def _text(raw: bytes, max_size: int | None) -> str | None:
    if (max_size is not None and len(raw) > max_size) or b"\0" in raw[: tx.BINARY_PREFIX]:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def in_head(findings: DataFrame, heads: DataFrame) -> DataFrame:
    """Raw findings with ``in_head``: whether their secret is in the file at HEAD; null where that isn't known."""
    return findings.join(heads, "path", "left").withColumn("in_head", F.contains("head_content", F.col("secret"))).drop("head_content")
