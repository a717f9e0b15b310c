"""Corpora to query: the tables' texts as files, each with one line of a credential made from its id, in DataFrames and in DuckDB SQL alike."""

from __future__ import annotations

import functools
import glob
import os
import pkgutil

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import IGNORE_MARKER


#: Bytes of a table, as it is stored, for a task that searches texts; a task may have four times as much before its rows are dealt out.
TASK_BYTES = 8 << 20


def row_groups(path: str) -> list[int] | None:
    """Stored bytes of a table's row groups on a local path, from the footers alone; null elsewhere."""
    local = path.removeprefix("file://")
    found = [local] if os.path.isfile(local) else sorted(glob.glob(f"{local}/*.parquet"))
    if not found:
        return None
    footers = [pq.ParquetFile(f).metadata for f in found]
    return [sum(g.column(c).total_compressed_size for c in range(g.num_columns)) for m in footers for g in map(m.row_group, range(m.num_row_groups))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; its rows are dealt out first, to tasks of about ``TASK_BYTES``, if it lies in fewer row groups than there are cores, which no
    reader can split, or if a row group or a split of the reader is more than a task may have. So a task's share doesn't grow with the table. Rows
    go by their place in the files: a task that deals out holds no texts, as it would to sort them for dealing in turn, and does the same again if it is repeated."""
    rows, groups, cores = table(spark, sf_dir, name), row_groups(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    conf = spark._jsparkSession.sessionState().conf()
    total = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = min(conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), total // cores))
    few, large = groups is not None and len(groups) < cores, max(split, *(groups or [0])) > 4 * TASK_BYTES
    return rows.repartition(max(4 * cores, -(-total // TASK_BYTES)), "_metadata.file_path", "_metadata.row_index") if few or large else rows


def planted_line(key: Column) -> Column:
    """By the key's residue of 7: a token, a cloud key, a payment key, a token without entropy, a marked token, an assignment, an assigned payment key."""
    sha, k = F.sha2(key.cast("string"), 256), F.pmod(key, F.lit(7))
    part = lambda n: F.substring(sha, 1, n)
    return (
        F.when(k == 0, F.concat(F.lit("key = ghp_"), part(36)))
        .when(k == 1, F.concat(F.lit("id = AKIA"), F.translate(F.upper(part(16)), "0189", "ABCD")))
        .when(k == 2, F.concat(F.lit("pay = sk_live_"), part(24)))
        .when(k == 3, F.lit("low = ghp_" + "a" * 36))
        .when(k == 4, F.concat(F.lit("key = ghp_"), part(36), F.lit(f" # {IGNORE_MARKER}")))
        .when(k == 5, F.concat(F.lit('api_key = "'), part(24), F.lit('"')))
        .otherwise(F.concat(F.lit('stripe_token = "sk_live_'), part(24), F.lit('"')))
    )


def planted_line_sql(key: str) -> str:
    part = lambda n: f"substr(sha256(CAST({key} AS VARCHAR)), 1, {n})"
    return (
        f"CASE (({key} % 7) + 7) % 7 WHEN 0 THEN 'key = ghp_' || {part(36)} WHEN 1 THEN 'id = AKIA' || translate(upper({part(16)}), '0189', 'ABCD')"
        f" WHEN 2 THEN 'pay = sk_live_' || {part(24)} WHEN 3 THEN 'low = ghp_' || repeat('a', 36) WHEN 4 THEN 'key = ghp_' || {part(36)} || ' # {IGNORE_MARKER}'"
        f""" WHEN 5 THEN 'api_key = "' || {part(24)} || '"' ELSE 'stripe_token = "sk_live_' || {part(24)} || '"' END"""
    )


@functools.cache
def samples() -> tuple[tuple[tuple[tuple[str, str], ...], str], ...]:
    """One line for each builtin regex, with the pattern and severity (two of them, where two patterns fit) that are to be found in it."""
    out = []
    for line in pkgutil.get_data(__name__, "samples.txt").decode().splitlines():
        found, _, text = line.partition(" ¦ ")
        out.append((tuple(tuple(x.split(" ")) for x in found.split(" + ")), text))
    return tuple(out)


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of all documents, each with one of the sample lines at its end, in turn."""
    lines = [x for _, x in samples()]
    d = spread_table(spark, sf_dir, "documents").select("doc_id", "text")
    line = F.element_at(F.array(*map(F.lit, lines)), (F.pmod("doc_id", F.lit(len(lines))) + 1).cast("int"))
    return d.select(F.col("doc_id").cast("string").alias("path"), F.concat("text", F.lit("\n"), line).alias("content"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of all documents; extensions go round."""
    d = spread_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    k, n = F.pmod("doc_id", F.lit(5)), F.col("doc_id").cast("string")
    name = F.when(k == 0, F.concat(n, F.lit(".py"))).when(k == 1, F.concat(n, F.lit(".js"))).when(k == 2, F.concat(n, F.lit(".go"))).when(k == 3, F.concat(F.lit(".env."), n)).otherwise(F.concat(n, F.lit(".md")))
    return d.select(F.concat(F.lit("src/"), F.coalesce("source", F.lit("none")), F.lit("/"), name).alias("path"), F.concat("text", F.lit("\n"), planted_line(F.col("doc_id"))).alias("content"))


def several_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files with a line of two tokens and one of a token at their start: several findings a file and a line."""
    f = files(spark, sf_dir)
    sha = F.sha2(F.col("path"), 256)
    part = lambda n: F.substring(sha, n, 36)
    return f.select("path", F.concat(F.lit("two = ghp_"), part(1), F.lit(" or ghp_"), part(9), F.lit("\n\nkey ghp_"), part(17), F.lit("\n"), "content").alias("content"))


FILES_SQL = f"""files AS (SELECT 'src/' || coalesce(source, 'none') || '/' || CASE ((doc_id % 5) + 5) % 5 WHEN 0 THEN doc_id || '.py' WHEN 1 THEN doc_id || '.js' WHEN 2 THEN doc_id || '.go'
    WHEN 3 THEN '.env.' || doc_id ELSE doc_id || '.md' END AS path, text || chr(10) || {planted_line_sql('doc_id')} AS content FROM documents)"""


def commit_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as a history: a turn is a commit (hash, parent, date) that writes one file (hash, path, content); conversations share secrets."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    h = lambda turn: F.sha2(F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string")), 256)
    rows = c.groupBy("conv_id", "turn").agg(F.min(F.coalesce("role", F.lit("none"))).alias("role"), F.min(F.coalesce("text", F.lit(""))).alias("text")).withColumn("hash", h(F.col("turn")))
    commits = rows.select("hash", F.when(F.col("turn") > 0, h(F.col("turn") - 1)).alias("parent"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 3600 + F.col("conv_id")).alias("date"))
    blobs = rows.select("hash", F.concat("role", F.lit(".txt")).alias("path"), F.concat("text", F.lit("\n"), planted_line(F.col("conv_id") % 70)).alias("content"))
    return commits, blobs


HISTORY_SQL = f"""turns AS (SELECT conv_id, turn, min(coalesce(role, 'none')) AS role, min(coalesce(text, '')) AS text, sha256(conv_id || '-' || turn) AS hash FROM conversations
    WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
commits AS (SELECT hash, CASE WHEN turn > 0 THEN sha256(conv_id || '-' || (turn - 1)) END AS parent, make_timestamp((1700000000 + turn * 3600 + conv_id) * 1000000) AS date FROM turns),
blobs AS (SELECT hash, role || '.txt' AS path, text || chr(10) || {planted_line_sql('(conv_id % 70)')} AS content FROM turns)"""
