"""Files as rows (path, content): folders, single files, and texts of any table."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .globs import excluded, ignored

MAX_FILE_SIZE = 1 << 20


def decoded(content: Column) -> Column:
    """Bytes as text; null where they aren't UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))


def usable(files: DataFrame, max_size: int | None = MAX_FILE_SIZE) -> DataFrame:
    """(path, content) of files (path, length, bytes) that are small enough, text and UTF-8. The size is tested first, so that large
    contents aren't read."""
    out = files if max_size is None else files.where(F.col("length") <= max_size)
    prefix = F.substring("bytes", 1, tx.BINARY_PREFIX)
    out = out.where(~F.contains(prefix, F.lit(bytearray(1)))).select("path", decoded(F.col("bytes")).alias("content"))
    return out.where(F.col("content").isNotNull())


def ignore_files(root: str) -> list[tuple[str, list[str]]]:
    """The ignore files under a root with their folders, outer ones first; the repository's own exclude file comes before them."""
    out = []
    info = Path(root, ".git", "info", "exclude")
    if info.is_file():
        out.append(("", info.read_text(errors="replace").splitlines()))
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n != ".git")
        if ".gitignore" in files:
            base = os.path.relpath(folder, root)
            out.append(("" if base == "." else base, Path(folder, ".gitignore").read_text(errors="replace").splitlines()))
    return out


def hidden(spark: SparkSession, root: str) -> DataFrame | None:
    """(inner, length, bytes) of the files that Spark's listing leaves out, those with a name or folder that begins with a dot or an
    underscore. The driver lists them; executors, which see the same folder, read them."""
    names = [os.path.relpath(os.path.join(f, n), root) for f, _, ns in os.walk(root) for n in ns]
    names = sorted(n for n in names if re.search(r"(^|/)[._]", n) and not re.search(r"(^|/)\.git/", n))
    if not names:
        return None

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                raw = Path(root, n).read_bytes()
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([len(raw)], pa.int64()), pa.array([raw], pa.binary())], names=["inner", "length", "bytes"])

    return spark.createDataFrame([(n,) for n in names], "inner string").mapInArrow(load, "inner string, length long, bytes binary")


def read(spark: SparkSession, paths: Iterable[str], excludes: Iterable[str] = (), respect_ignores: bool = True, max_size: int | None = MAX_FILE_SIZE) -> DataFrame:
    """(path, content) of all text files under the paths; hidden files count, version control's own folder doesn't. A path that is a
    file is taken whatever the globs and ignore files say."""
    parts = []
    for given in paths:
        local = given.removeprefix("file://")
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        if os.path.isfile(local):
            one = raw.load("file://" + os.path.abspath(local)).select(F.lit(given).alias("path"), "length", F.col("content").alias("bytes"))
            parts.append(usable(one, max_size))
            continue
        root = os.path.abspath(local) if "://" not in given or given.startswith("file://") else given.rstrip("/")
        # the JVM has a working folder of its own: local paths are given to it whole
        found = raw.load("file://" + root if os.path.isdir(root) else given).withColumn("full", F.regexp_replace("path", r"^file:/+", "/"))
        inner = F.regexp_replace("full", "^" + re.escape(root) + "/*", "")
        rows = found.select(inner.alias("inner"), "length", F.col("content").alias("bytes"))
        unlisted = hidden(spark, root) if os.path.isdir(root) else None
        rows = rows if unlisted is None else rows.unionByName(unlisted)
        rows = rows.withColumn("path", F.concat(F.lit(given.rstrip("/") + "/"), F.col("inner")))
        rows = rows.where(~F.col("inner").rlike(r"(^|/)\.git/") & ~tx.has_binary_extension(F.col("inner")) & ~excluded(F.col("inner"), excludes))
        if respect_ignores and os.path.isdir(local):
            rows = rows.where(~ignored(F.col("inner"), ignore_files(root)))
        parts.append(usable(rows.drop("inner"), max_size))
    if not parts:
        return spark.createDataFrame([], "path string, content string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def of_table(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    """Any table's texts as files."""
    return rows.select(path.cast("string").alias("path"), content.cast("string").alias("content"))


def spread(files: DataFrame, target_bytes: int = 32 << 20) -> DataFrame:
    """Files in partitions of about equal bytes: a range of cumulated size would need a sort, so they are dealt out by a hash, as many
    partitions as the bytes ask for. One pass counts them."""
    total = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    return files.repartition(max(1, -(-int(total) // target_bytes)), F.xxhash64("path"))
