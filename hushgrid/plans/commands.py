"""The commands as plans over DataFrames: scan, fix, history, baseline. Each is lazy; a report is its one action."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as hist
from ..operators import suppress as sup
from ..operators.scan import ScanOptions, at_least, scan
from ..operators.verify import Verifier, verify
from ..sources.config import Config


@dataclass
class Scanned:
    """The findings to show, all findings before suppression, and the ignore set."""

    shown: DataFrame
    found: DataFrame
    ignored: DataFrame
    minimum: str

    def stats(self) -> DataFrame:
        return sup.scan_stats(self.found, self.ignored, self.minimum)


def options(config: Config, severity: str | None = None) -> ScanOptions:
    """A given severity wins over the configured one."""
    return ScanOptions(registry=config.registry(), severity=severity or config.severity or "low")


def baseline_of(spark: SparkSession, config: Config, path: str | None = None) -> DataFrame:
    """The baseline at a path; a missing one is an error only if the path was given, not if it was configured."""
    empty = spark.createDataFrame([], sup.BASELINE)
    if path:
        return sup.load(spark, path)
    return sup.load(spark, config.baseline_path) if config.baseline_path and os.path.exists(config.baseline_path) else empty


def run_scan(files: DataFrame, config: Config | None = None, severity: str | None = None, minimum: str | None = None, baseline: str | None = None) -> Scanned:
    c = config or Config()
    spark = files.sparkSession
    found = scan(files, options(c, severity))
    ignored = sup.ignore_set(baseline_of(spark, c, baseline), c.ignores(spark))
    least = minimum or c.minimum_confidence
    return Scanned(at_least(sup.suppress(found, ignored), least), found, ignored, least)


def run_verification(raw: DataFrame, shown: DataFrame, verifiers: dict[str, Verifier], verified_at: str) -> DataFrame:
    """Verifications of the findings that are shown; ``raw`` has their secrets."""
    return verify(raw.join(shown.select("id").distinct(), "id", "left_semi"), verifiers, verified_at)


def run_history(commits: DataFrame, blobs: DataFrame, config: Config | None = None, severity: str | None = None, minimum: str | None = None, keep_all: bool = False) -> DataFrame:
    """Secrets by date of introduction; a history has no baseline."""
    c = config or Config()
    found = hist.occurrences(commits, blobs, options(c, severity))
    return at_least(hist.first_introductions(found, keep_all), minimum or c.minimum_confidence).orderBy("introduced_at", "pattern_id", "id")


def accept(files: DataFrame, config: Config, baseline: DataFrame, status: str, reason: str | None, now: int, severity: str | None = None, minimum: str | None = None) -> DataFrame:
    """The baseline with all unknown findings of at least a confidence (high, if nothing else is said) added."""
    new = sup.unknown(scan(files, options(config, severity)), baseline, minimum or "high")
    return sup.upsert(baseline, sup.reviewed(new, status, reason, now))


def repeated_lines(found: DataFrame) -> DataFrame:
    """(path, line, n) of lines with more than one finding."""
    return found.groupBy("path", "line").agg(F.count("*").alias("n")).where("n > 1")
