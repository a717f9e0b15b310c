"""Secrets in a commit history: where each came in, and where it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .scan import ScanOptions, raw_findings


def changed_files(trees: DataFrame, parents: DataFrame) -> DataFrame:
    """(hash, path, blob) that a commit adds or alters against its first parent, from trees (hash, path, blob) and parents (hash, parent; null for a root)."""
    old = parents.where("parent is not null").join(trees.withColumnRenamed("hash", "parent").withColumnRenamed("blob", "old"), "parent").select("hash", "path", "old")
    return trees.join(parents.select("hash"), "hash", "left_semi").join(old, ["hash", "path"], "left").where(~F.col("blob").eqNullSafe(F.col("old"))).select("hash", "path", "blob")


def staged(index: DataFrame, head: DataFrame) -> DataFrame:
    """The entries of the index (path, blob) that differ from the head's; all of them without a head."""
    return index.join(head.select("path", F.col("blob").alias("old")), "path", "left").where(~F.col("blob").eqNullSafe(F.col("old"))).select("path", "blob")


def walk(commits: DataFrame, limit: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Commits newest first with their place in the walk, later than ``since`` and not later than ``until`` (days)."""
    kept = commits
    if since:
        kept = kept.where(F.col("date") > F.to_timestamp(F.concat(F.lit(since), F.lit(" 23:59:59"))))
    if until:
        kept = kept.where(F.col("date") <= F.to_timestamp(F.concat(F.lit(until), F.lit(" 23:59:59"))))
    return kept.orderBy(F.desc("date"), "hash").limit(limit) if limit is not None else kept


def first_parent(commits: DataFrame, head: str) -> list[str]:
    """Hashes of the first-parent line from a commit back. Pointers double in each round (2^k-th ancestors), so a line of n commits takes log n
    joins; only the line itself, which is the result, comes to the driver."""
    jump = commits.select("hash", "parent").where("parent is not null")
    line = commits.where(F.col("hash") == head).select("hash", F.lit(0).cast("long").alias("n"))
    step, size = 1, line.count()
    while size:
        ahead = line.join(jump, "hash").select(F.col("parent").alias("hash"), (F.col("n") + step).alias("n")).join(commits.select("hash"), "hash", "left_semi")
        line = line.unionAll(ahead).checkpoint() if line.sparkSession.conf.get("spark.checkpoint.dir", None) else line.unionAll(ahead).cache()
        now = line.count()
        if now < size + step:
            break
        jump = jump.join(jump.select(F.col("hash").alias("parent"), F.col("parent").alias("next")), "parent").select("hash", F.col("next").alias("parent"))
        step, size = 2 * step, now
    return [r[0] for r in line.orderBy("n").collect()]


def occurrences(commits: DataFrame, files: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """Findings of files (hash, path, content) with their commits. Every content is scanned where it lies; findings alone are joined."""
    found = raw_findings(files.select(F.concat("path", F.lit("\0"), "hash").alias("path"), "content"), options)
    hashed = found.withColumn("hash", F.substring_index("path", "\0", -1)).withColumn("path", F.substring_index("path", "\0", 1))
    rows = hashed.withColumn("fingerprint", tx.fingerprint(F.col("pattern_id"), F.col("path"), F.col("secret_hash")))
    return rows.join(commits, "hash")


def first_introductions(found: DataFrame, keep_all: bool = False) -> DataFrame:
    """One row for each secret of each pattern: the earliest occurrence, how many there are, one representative; with ``keep_all`` all of
    them. Of equal dates the newest-first walk's first commit counts, by hash."""
    known = [c for c in ("short_hash", "author_name", "author_email", "message") if c in found.columns]
    place = F.struct("date", F.col("hash"), "path", "line", "column", "masked_line", *known)
    latest = F.struct("date", F.col("hash"), "path", "line", "column", "masked_line", "secret_masked", "id", "severity", "confidence")
    aggs = [F.count("*").alias("occurrence_count"), F.min(place).alias("introduced"), F.max(latest).alias("shown")]
    if keep_all:
        aggs.append(F.sort_array(F.collect_list(place)).alias("occurrences"))
    out = found.groupBy("pattern_id", "secret_hash").agg(*aggs)
    return out.select("pattern_id", "secret_hash", F.col("shown.id").alias("id"), F.col("shown.severity").alias("severity"), F.col("shown.confidence").alias("confidence"), F.col("shown.path").alias("path"), F.col("shown.masked_line").alias("masked_line"), F.col("shown.secret_masked").alias("secret_masked"), "introduced", F.col("introduced.hash").alias("introduced_in"), F.col("introduced.date").alias("introduced_at"), "occurrence_count", *(["occurrences"] if keep_all else []))


def adjacent_once(found: DataFrame) -> DataFrame:
    """Occurrences of a secret without those whose commit is that of the one before."""
    w = Window.partitionBy("pattern_id", "secret_hash").orderBy(F.desc("date"), "hash", "path", "line", "column")
    return found.withColumn("_last", F.lag("hash").over(w)).where(~F.col("hash").eqNullSafe(F.col("_last"))).drop("_last")
