"""MinHash near-dedup with bottom-k sketches from one hash function.

A text is the set of hashes of its word trigrams (lower case, punctuation dropped); its sketch is the K smallest. Equal sets are
linked through a 128-bit digest of the set. For the others, inverted lists of retained values give the pairs that share some; the
sketch of the union estimates their similarity, and exact Jaccard similarity of the whole sets verifies them.

Lists stay short without any cap: a pair whose union sketch passes shares at least ``t`` retained values, so each text is listed only
under its rarest m - t + 1 of m values that occur at all elsewhere. Passages that many texts share are the most frequent
values and so come last. Of the pairs of a list, those with its smallest member come first; members that are in one group by
then need no pair among themselves, so a group of thousands of copies costs a star instead of a clique. Lists are counted and their
smallest members found by aggregation before any exchange; a list too long for a task is cut into blocks that meet pair by pair.

Groups are the connected components of the verified pairs; the smallest doc_id of each stays.

Defined cases: a text that is null, empty or without a word is nobody's copy, and so is a row without doc_id; a text of one or two
words is one shingle; texts of any length are read whole; a pair at the threshold is near; of equally rare values the smaller is listed
first; rows that repeat a doc_id count as one document; an empty table gives an empty result; other columns, whatever their names, aren't
read, and filtering keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkern as tk
from .common import discard, fresh, materialise, small_side
from .graph import components
from .joins import one_sided_pairs

K = 128
SHINGLE = 3
#: In the gap between copies and strangers: three trigrams go with each changed word, so a copy with a tenth of its words changed is at about 0.57.
THRESHOLD = 0.5
#: Standard deviations of the estimate that a candidate may lie below the threshold.
DEVIATIONS = 3.6


def least_estimate(threshold: float, k: int = K) -> float:
    """Least estimate of a candidate: DEVIATIONS below the threshold, those of the share of k draws. About 0.34 at 0.5."""
    return max(1 / k, threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / k))


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (63 bits) of each text."""
    t = tk.Text(data, off)
    h, text, _, _ = tk.words(t)
    n = len(off) - 1
    at = np.searchsorted(text, np.arange(n + 1))
    g = h.copy()
    for k in range(1, SHINGLE):
        g[: len(h) - k] = g[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
    g = (tk.splitmix(g) >> np.uint64(1)).astype(np.int64)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(g[a : b - SHINGLE + 1]))
        elif b > a:  # fewer words than a shingle: one shingle of all
            x = np.array([b - a], np.uint64)
            for w in range(a, b):
                x = x * np.uint64(0x9E3779B97F4A7C15) + h[w : w + 1]
            out.append((tk.splitmix(x) >> np.uint64(1)).astype(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def all_sets(column: pa.Array) -> Iterator[np.ndarray]:
    data, off = tk.utf8(column)
    for a, b in tk.chunks(off):
        yield from shingle_sets(data[off[a] : off[b]], off[a : b + 1])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, size of the shingle set, its digest in two longs, and the ascending sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, size, d1, d2, low = [], [], [], [], []
            for i, s in enumerate(all_sets(batch.column(1))):
                if len(s):
                    keep.append(i)
                    size.append(len(s))
                    x = tk.splitmix(s.astype(np.uint64))
                    d1.append(int(x.sum(dtype=np.uint64).astype(np.int64)))
                    d2.append(int(np.bitwise_xor.reduce(tk.splitmix(x ^ np.uint64(0xA5A5A5A5))).astype(np.int64)))
                    low.append(s[:K])
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(low) if low else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists], names=["doc_id", "size", "d1", "d2", "sketch"])

    docs = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return docs.where(docs["doc_id"].isNotNull()).mapInArrow(run, "doc_id long, size long, d1 long, d2 long, sketch array<long>")


def jaccard(pairs: DataFrame) -> DataFrame:
    """Of (a, b, text_a, text_b): a, b and the exact similarity of their whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(all_sets(batch.column(2)), all_sets(batch.column(3)), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / max(1, len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "jaccard"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, jaccard double")


def verified(pairs: DataFrame, sk: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The candidate pairs (a, b) that union sketches, then exact similarity leave."""
    side = lambda c: sk.select(F.col("doc_id").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("size_a") >= threshold * F.col("size_b")) & (F.col("size_b") >= threshold * F.col("size_a")))
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, K)
    shared = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
    candidates = materialise(both.where(shared >= least_estimate(threshold) * F.size(union)).select("a", "b").distinct())
    ids = materialise(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = docs.where(F.col("doc_id").isNotNull()).join(small_side(ids), F.col("doc_id") == F.col("id"), "left_semi")
    text = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    out = materialise(jaccard(candidates.join(text("a"), "a").join(text("b"), "b")).where(F.col("jaccard") >= threshold))
    discard(docs.sparkSession, [candidates, ids])
    return out


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root): every document that is a near-copy, and the smallest doc_id of its group."""
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    sk = materialise(sketches(docs))
    equal = sk.groupBy("size", "d1", "d2").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    texts_of_equal = materialise(equal)
    equal = materialise(sk.join(small_side(texts_of_equal), ["size", "d1", "d2"]).where("doc_id <> a").select("a", F.col("doc_id").alias("b")))
    single = sk.join(small_side(equal.select(F.col("b").alias("doc_id")).distinct()), "doc_id", "left_anti")
    posts = single.select("doc_id", "size", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    listed = posts.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    mine = Window.partitionBy("doc_id")  # K rows at most
    ranked = posts.join(listed, "v").withColumns({"m": F.count("*").over(mine), "r": F.row_number().over(mine.orderBy("f", "v"))})
    index = materialise(ranked.where(F.col("r") <= F.col("m") - F.ceil(F.col("s") * F.lit(least_estimate(threshold))) + 1).select(F.col("v").alias("key"), F.col("doc_id").alias("id"), "size"))
    near_sizes = lambda x, y: (F.col(x) >= threshold * F.col(y)) & (F.col(y) >= threshold * F.col(x))
    least = index.groupBy("key").agg(F.min(F.struct("id", "size")).alias("first"))
    star = index.join(least, "key").where("id <> first.id").where(near_sizes("size", "first.size")).select(F.col("first.id").alias("a"), F.col("id").alias("b")).distinct()
    first = verified(star, sk, docs, threshold)
    roots = components(first.select("a", "b"))
    linked = index.join(small_side(roots.select(F.col("node").alias("id"), "root")), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"), "size")
    rest = one_sided_pairs(linked, ["size"], lambda p, x, y: np.minimum(p[0][x], p[0][y]) >= threshold * np.maximum(p[0][x], p[0][y]))
    second = verified(rest, sk, docs, threshold)
    edges = equal.unionAll(first.select("a", "b")).unionAll(second.select("a", "b"))
    out = components(edges)
    discard(spark, [sk, index, roots, rest, first, second, equal, texts_of_equal])
    return out


def copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id is a kept document; copy_id a near-copy in its group that goes, null for the kept one itself."""
    out = groups(docs, threshold)
    ids = docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id")).distinct()
    gone = out.select(F.col("root").alias("doc_id"), F.col("node").alias("copy_id"))
    kept = ids.join(small_side(out.select(F.col("node").alias("doc_id"))), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("long").alias("copy_id"))
    return kept.unionAll(gone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without the near-copies, all columns unchanged. Rows without doc_id stay."""
    name = fresh(docs.columns, "gone_id")
    gone = small_side(groups(docs, threshold).select(F.col("node").alias(name)))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
