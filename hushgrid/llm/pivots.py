"""Embedding near-dedup with a pivot-permutation index.

A vector is described by its PREFIX nearest reference points (pivots), in order of nearness. Inverted lists hold the vectors of SHARED
pivots each: two vectors meet in a list exactly if the pivots that they share number SHARED or more. Of a pair that meets, the shared
pivots are counted and their places in both orders compared: a pair is a candidate if the places, a missing pivot taken to be at PREFIX, differ
by MOST_MOVED in sum at most, and if its 64-bit sign codes differ in no more bits than those of a pair at the threshold may (four standard
deviations). Candidates are verified by their cosine. The pivots are well-spread vectors of the table; their number grows with
the cube root of the table, so that the lists stay about as long.

In each list the pairs with its smallest member come first; members that are in one group by then need no pair among themselves,
so that a group of thousands of copies costs a star instead of a clique. Lists too long for a task are cut into blocks that meet pair
by pair. Equal vectors are linked by their digest. The index is approximate; its recall is measured against brute force in the tests.

Groups are the connected components of the verified pairs; the smallest vec_id stays.

Defined cases: a row without vec_id, a null, zero or non-finite vector, or one of another length than most, is nobody's copy; rows that repeat
a vec_id count as one vector; ties between equally near pivots go to the first pivot; a pair whose cosine is the threshold is near; an empty
table gives an empty result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small_side
from .graph import components
from .joins import one_sided_pairs

THRESHOLD = 0.95
PREFIX = 7
SHARED = 3
#: Sum of the differences of places of a candidate's pivots. At a cosine of 0.95 it is 18 in the median and above 40 in one pair of 200.
MOST_MOVED = 40
_BITS = 15  # of a pivot's number


def n_pivots(rows: int) -> int:
    """Pivots for so many vectors; numbers of _BITS bits reach to 10^11 vectors."""
    return int(np.clip(round(128 * (max(rows, 1) / 10_000) ** (1 / 3)), 32, 1 << _BITS))


def most_bits(threshold: float) -> int:
    """Bits of the sign codes in which a pair may differ: the mean at the threshold and four standard deviations."""
    p = float(np.arccos(np.clip(threshold, -1, 1)) / np.pi)
    return int(np.ceil(64 * p + 4 * np.sqrt(64 * p * (1 - p))))


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the vectors, no two of them close to one another if there are enough."""
    picked: list[int] = []
    for limit in (0.5, 0.7, 0.9, 2.0):
        for i in range(len(vectors)):
            if len(picked) == n:
                break
            if i not in picked and (not picked or (vectors[picked] @ vectors[i]).max() <= limit):
                picked.append(i)
    return vectors[picked]


def unit(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of length 1."""
    x = np.asarray(column.flatten(), np.float32).reshape(len(column), -1)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def permutations(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :PREFIX]


def packed(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The orders in two longs: the four nearest pivots, and the rest; a missing one is all ones."""
    full = np.full((len(order), PREFIX), (1 << _BITS) - 1, np.int64)
    full[:, : order.shape[1]] = order
    join = lambda c: (c << (_BITS * np.arange(c.shape[1]))).sum(1)
    return join(full[:, :4]), join(full[:, 4:])


def unpacked(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    mask = (1 << _BITS) - 1
    return np.stack([near >> (_BITS * k) & mask for k in range(4)] + [far >> (_BITS * k) & mask for k in range(PREFIX - 4)], 1)


def moved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared pivots of two orders, and the sum of the differences of places, a pivot that one lacks being at PREFIX there."""
    none = (1 << _BITS) - 1
    same = (a[:, :, None] == b[:, None, :]) & (a != none)[:, :, None]
    place = np.arange(PREFIX)
    lacks = (~same.any(2) & (a != none)) @ (PREFIX - place) + (~same.any(1) & (b != none)) @ (PREFIX - place)
    return same.sum((1, 2)), (same * np.abs(place[:, None] - place)).sum((1, 2)) + lacks


def codes(x: np.ndarray) -> np.ndarray:
    planes = np.random.default_rng(5).standard_normal((x.shape[1], 64)).astype(np.float32)
    return (((x @ planes) > 0) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64).astype(np.int64)


def groups(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root): every vector that is a near-copy, and the smallest vec_id of its group."""
    spark = vectors.sparkSession
    raw = vectors.where(vectors["vec_id"].isNotNull()).select(vectors["vec_id"].cast("long").alias("id"), vectors["embedding"].cast("array<float>").alias("v"))
    most = raw.where("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if not most or not most[0]:
        return spark.createDataFrame([], "node long, root long")
    fine = raw.where((F.size("v") == most[0]) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0))
    equal = fine.groupBy(F.unhex(F.sha2(F.array_join("v", ",").cast("binary"), 256)).alias("d")).agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = materialise(equal)
    equal = materialise(fine.join(small_side(same), F.unhex(F.sha2(F.array_join("v", ",").cast("binary"), 256)) == F.col("d")).where("id <> a").select("a", F.col("id").alias("b")))
    single = fine.join(small_side(equal.select(F.col("b").alias("id")).distinct()), "id", "left_anti")
    total = single.count()
    n = n_pivots(total)
    sample = single.orderBy(F.xxhash64("id"), "id").limit(8 * n).select("v").collect()
    if not sample:
        return components(equal)
    x = np.array([r[0] for r in sample], np.float32)
    shared = spark.sparkContext.broadcast(choose_pivots(x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32), n))
    k = min(PREFIX, len(shared.value))
    sets = list(itertools.combinations(range(k), min(SHARED, k)))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unit(batch.column(1))
            order = permutations(v, shared.value)
            near, far = packed(order)
            order, code, ids = np.sort(order, axis=1).astype(np.int64), codes(v), batch.column(0).to_numpy()
            for chosen in sets:
                key = np.zeros(len(ids), np.int64)
                for j in chosen:
                    key = (key << _BITS) + order[:, j]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, ids, code, near, far)], names=["key", "id", "code", "near", "far"])

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (unit(batch.column(2)).astype(np.float64) * unit(batch.column(3))).sum(1) >= threshold
                yield batch.select([0, 1]).filter(pa.array(near))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c: fine.select(F.col("id").alias(c), F.col("v").alias(f"v_{c}")).dropDuplicates([c])
        return materialise(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "v_a", "v_b").mapInArrow(cosine, "a long, b long"))

    bits = most_bits(threshold)

    def accept(payload: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        code, near, far = payload
        ok = np.bitwise_count(code[x] ^ code[y]) <= bits
        at = np.flatnonzero(ok)
        common, far_apart = moved(unpacked(near[x[at]], far[x[at]]), unpacked(near[y[at]], far[y[at]]))
        ok[at] = (common >= len(sets[0])) & (far_apart <= MOST_MOVED)
        return ok

    index = materialise(single.select("id", "v").mapInArrow(post, "key long, id long, code long, near long, far long"))
    least = index.groupBy("key").agg(F.min(F.struct("id", "code")).alias("first"))
    star = index.join(least, "key").where((F.col("id") != F.col("first.id")) & (F.bit_count(F.col("code").bitwiseXOR(F.col("first.code"))) <= bits))
    first = verified(star.select(F.col("first.id").alias("a"), F.col("id").alias("b")).distinct())
    roots = components(first)
    linked = index.join(small_side(roots), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    rest = one_sided_pairs(linked, ["code", "near", "far"], accept)
    second = verified(rest)
    out = components(equal.unionAll(first).unionAll(second))
    discard(spark, [same, equal, index, first, roots, rest, second])
    return out


def copies(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id is a kept vector; copy_id a near-copy in its group that goes, null for the kept one itself."""
    out = groups(vectors, threshold)
    ids = vectors.where(vectors["vec_id"].isNotNull()).select(vectors["vec_id"].cast("long").alias("vec_id")).distinct()
    kept = ids.join(small_side(out.select(F.col("node").alias("vec_id"))), "vec_id", "left_anti").select("vec_id", F.lit(None).cast("long").alias("copy_id"))
    return kept.unionAll(out.select(F.col("root").alias("vec_id"), F.col("node").alias("copy_id")))
