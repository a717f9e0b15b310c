"""Baselines and ignores: findings that are known don't count."""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = "1"
BASELINE = "fingerprint string, pattern_id string, severity string, file string, secret_hash string, status string, reason string, reviewed_at long"
STATUSES = ("accepted", "ignored")


class BaselineError(ValueError):
    """A baseline file that can't be used; ``kind`` is missing, parse or version."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def load(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a baseline file. Baselines are small: the driver reads them."""
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as e:
        raise BaselineError("missing", f"no baseline at {path}") from e
    except ValueError as e:
        raise BaselineError("parse", f"not a baseline: {path}") from e
    if not isinstance(raw, dict) or str(raw.get("version")) != VERSION:
        raise BaselineError("version", f"the version of {path} isn't {VERSION}")
    names = [c.split()[0] for c in BASELINE.split(", ")]
    return spark.createDataFrame([tuple(f.get(n) for n in names) for f in raw.get("findings", [])], BASELINE)


def save(baseline: DataFrame, path: str, now: int | None = None) -> None:
    """Write a baseline in one step: to a file beside it, which then takes its name. The time of creation stays."""
    now = int(time.time()) if now is None else now
    try:
        created = json.loads(Path(path).read_text(encoding="utf-8")).get("created_at", now)
    except (OSError, ValueError):
        created = now
    rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in baseline.orderBy("file", "pattern_id", "fingerprint").collect()]
    write_whole(path, json.dumps({"version": VERSION, "created_at": created, "updated_at": now, "findings": rows}, indent=2, ensure_ascii=False) + "\n")


def write_whole(path: str, text: str) -> None:
    """Replace a file's content so that no reader sees a part of it."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder, prefix=f".{os.path.basename(path)}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def reviewed(findings: DataFrame, status: str = "accepted", reason: str | None = None, at: int = 0) -> DataFrame:
    """Findings as rows of a baseline, one a fingerprint."""
    if status not in STATUSES:
        raise ValueError(f"unknown status: {status}")
    first = Window.partitionBy("fingerprint").orderBy("path", "byte_start", "pattern_id")
    one = findings.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return one.select("fingerprint", "pattern_id", "severity", F.col("path").alias("file"), "secret_hash", F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"), F.lit(at).cast("long").alias("reviewed_at"))


def ignore_set(baseline: DataFrame | None, ignores: DataFrame | None = None) -> DataFrame:
    """Distinct fingerprints of the baseline, whatever their status, and of the configured ignores."""
    parts = [x.select("fingerprint") for x in (baseline, ignores) if x is not None]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.where("fingerprint is not null").distinct()


def suppress(findings: DataFrame, ignored: DataFrame) -> DataFrame:
    """The findings that aren't in the set. The set is small as a rule; Spark broadcasts it by its measured size."""
    return findings.join(ignored, "fingerprint", "left_anti").select(*findings.columns)


def upsert(baseline: DataFrame, new: DataFrame) -> DataFrame:
    """The baseline with new rows in place of those of the same fingerprint."""
    return baseline.join(new.select("fingerprint"), "fingerprint", "left_anti").select(*baseline.columns).unionByName(new)


def unknown(findings: DataFrame, baseline: DataFrame, minimum: str = "high") -> DataFrame:
    """What is left to review: of at least a confidence, not in the baseline."""
    new = suppress(findings, ignore_set(baseline))
    return new if minimum == "low" else new.where("confidence = 'high'")


def stats(baseline: DataFrame) -> DataFrame:
    """(kind, name, n, percent): counts by status and severity, and of all, with whole percents."""
    total = baseline.agg(F.count("*").alias("total"))
    by = baseline.select(F.explode(F.array(F.struct(F.lit("status").alias("kind"), F.col("status").alias("name")), F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("name")))).alias("x"))
    counts = by.groupBy("x.kind", "x.name").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    parts = counts.select("kind", "name", "n", (F.col("n") * 100 / F.col("total")).cast("int").alias("percent"))
    return parts.unionByName(total.select(F.lit("total").alias("kind"), F.lit("all").alias("name"), F.col("total").alias("n"), F.when(F.col("total") > 0, 100).otherwise(0).cast("int").alias("percent")))


def top_patterns(baseline: DataFrame, n: int = 10) -> DataFrame:
    return baseline.groupBy("pattern_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern_id").limit(n)


def review_span(baseline: DataFrame) -> DataFrame:
    """The oldest and the newest review; ties by fingerprint."""
    first, last = F.min(F.struct("reviewed_at", "fingerprint")), F.max(F.struct(F.col("reviewed_at"), F.col("fingerprint")))
    return baseline.agg(first.alias("o"), last.alias("n")).select(F.col("o.reviewed_at").alias("oldest_at"), F.col("o.fingerprint").alias("oldest"), F.col("n.reviewed_at").alias("newest_at"), F.col("n.fingerprint").alias("newest"))


def scan_stats(findings: DataFrame, ignored: DataFrame, minimum: str = "high") -> DataFrame:
    """One row: all findings, those in the ignore set, those below the confidence, those shown."""
    known = findings.join(ignored.withColumn("_known", F.lit(True)), "fingerprint", "left")
    low = F.lit(False) if minimum == "low" else F.col("confidence") != "high"
    k = F.coalesce("_known", F.lit(False))
    return known.agg(F.count("*").alias("total"), F.count_if(k).alias("baseline"), F.count_if(~k & low).alias("filtered"), F.count_if(~k & ~low).alias("shown"))
