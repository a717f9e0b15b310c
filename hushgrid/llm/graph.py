"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _large(edges: DataFrame) -> DataFrame:
    """Edges have a < b. The least neighbour of a node is aggregated before any exchange, so the centre of a huge star is no hot key of it."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.least("a", "m").alias("a"), "b").where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges have a < b, so that of each b all smaller neighbours are its a's."""
    linked = edges.join(edges.groupBy("b").agg(F.min("a").alias("m")), "b")
    return linked.select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots; the root is the smallest node of its component.

    Each round is written to the shared folder, so the lineage stays short; rounds grow with the logarithm of the nodes."""
    spark = edges.sparkSession
    now = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sign == seen or not sign[0]:
            out = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
            out._hushgrid_path = now._hushgrid_path  # for discard
            return out
        seen, then = sign, materialise(_small(_large(now)))
        discard(spark, [now])
        now = then
