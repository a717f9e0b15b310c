"""Candidate pairs from keyed rows: one exchange by key, then a stream over each sorted partition.

A task holds at most CHUNK rows and a key of LIMIT rows. The rows of a longer key go out again as they came, without any pair; they are cut
into blocks by a hash of their id, every left block meets every right block in a cell of its own, and the cells are spread over the cluster.
No pair is lost, and no task holds a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small_side

#: Pairs of a batch that are sent on at most.
BATCH = 1 << 16
#: Rows that a task gathers before it looks for pairs.
CHUNK = 1 << 16
#: Rows of a key that are paired in one task; a longer key is cut into blocks.
LIMIT = 1 << 14
BLOCK = 1 << 12

Pairs = Iterator[tuple[np.ndarray, np.ndarray]]
#: Which of the pairs of rows x and y, given the payload columns, may be candidates.
Accept = Callable[[list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def _within(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate([[True], new]))


def _crossed(begin_x: np.ndarray, n_x: np.ndarray, begin_y: np.ndarray, n_y: np.ndarray) -> Pairs:
    """Rows (x, y) of the products of ranges, in slices, so that a long key never makes one huge array."""
    groups = np.flatnonzero((n_x > 0) & (n_y > 0))
    rows = np.repeat(begin_x[groups], n_x[groups]) + _within(n_x[groups])
    of = np.repeat(groups, n_x[groups])
    total, at = np.cumsum(n_y[of]), 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH, "right")))
        g = of[at:to]
        yield np.repeat(rows[at:to], n_y[g]), np.repeat(begin_y[g], n_y[g]) + _within(n_y[g])
        at = to


def _sides(key: np.ndarray, a: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, Pairs]:
    """The order of the rows by key, right rows (0) first, then those of both sides (1), then left ones (2), without repeated ones; and, in
    that order, all pairs of a left and a right row of a key."""
    order = np.lexsort((a, left, key))
    order = order[_firsts(key[order], left[order], a[order])]
    key, left = key[order], left[order]
    first = _firsts(key)
    size = np.diff(np.append(first, len(key)))
    n_right, n_left = np.add.reduceat((left < 2).astype(np.int64), first), np.add.reduceat((left > 0).astype(np.int64), first)
    return order, _crossed(first + size - n_left, n_left, first, n_right)


def _two_sides(columns: list[np.ndarray], cells: bool) -> Pairs:
    """Pairs of a left and a right row of one key, from (key, id, left)."""
    order, found = _sides(*columns)
    a = columns[1][order]
    for x, y in found:
        x, y = a[x], a[y]
        other = x != y
        yield np.minimum(x[other], y[other]), np.maximum(x[other], y[other])


def _one_side(accept: Accept) -> Callable[[list[np.ndarray], bool], Pairs]:
    """Pairs of rows of one key with other roots, from (key, id, root, payload…); in cells, where ``left`` comes last, of left and right rows."""

    def pairs(columns: list[np.ndarray], cells: bool) -> Pairs:
        key, a, root = columns[:3]
        if cells:
            order, found = _sides(key, a, columns[-1])
            payload = columns[3:-1]
        else:
            order = np.lexsort((a, root, key))
            order = order[_firsts(key[order], a[order])]
            run, first = _firsts(key[order], root[order]), _firsts(key[order])
            end = np.append(first, len(order))[1:][np.searchsorted(first, run, "right") - 1]
            after = np.append(run, len(order))[1:]
            found, payload = _crossed(run, after - run, after, end - after), columns[3:]
        a, root, payload = a[order], root[order], [c[order] for c in payload]
        for x, y in found:
            other = root[x] != root[y]
            x, y = x[other], y[other]
            ok = accept(payload, x, y)
            x, y = a[x[ok]], a[y[ok]]
            yield np.minimum(x, y), np.maximum(x, y)

    return pairs


def _stream(rows: DataFrame, names: list[str], pairs: Callable[[list[np.ndarray], bool], Pairs], cells: bool) -> DataFrame:
    """(a, b) of the pairs and, with null a and b, the rows of keys longer than LIMIT (``names``). In ``cells`` no key is too long."""
    chunk, limit = CHUNK, LIMIT
    late = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((f"_{n}", pa.int64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def deferred(rows_: list[np.ndarray]) -> pa.RecordBatch:
            none = pa.nulls(len(rows_[0]), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, *(pa.array(c, pa.int64()) for c in rows_)], schema=late)

        def send(rows_: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if not len(rows_[0]):
                return
            if not cells:
                first = _firsts(rows_[0])
                size = np.diff(np.append(first, len(rows_[0])))
                if size.max() > limit:
                    long = np.repeat(size > limit, size)
                    yield deferred([c[long] for c in rows_])
                    rows_ = [c[~long] for c in rows_]
                    if not len(rows_[0]):
                        return
            for x, y in pairs(rows_, cells):
                if len(x):
                    none = pa.nulls(len(x), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), *[none] * len(names)], schema=late)

        rest: list[list[np.ndarray]] = []
        n, open_key = 0, None  # open_key: a long key that still goes on
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if open_key is not None:
                m = int(np.searchsorted(now[0], open_key, "right"))
                if m:
                    yield deferred([c[:m] for c in now])
                now = [c[m:] for c in now]
            if not len(now[0]):
                continue
            open_key = None
            rest.append(now)
            n += len(now[0])
            if n >= chunk:
                every = [np.concatenate(c) for c in zip(*rest, strict=True)]
                last = int(np.searchsorted(every[0], every[0][-1]))
                yield from send([c[:last] for c in every])
                rest, n = [[c[last:] for c in every]], len(every[0]) - last
                if n > limit and not cells:
                    yield deferred(rest[0])
                    open_key, rest, n = every[0][-1], [], 0
        if rest:
            yield from send([np.concatenate(c) for c in zip(*rest, strict=True)])

    schema = "a long, b long, " + ", ".join(f"_{n} long" for n in names)
    return rows.select(*[F.col(c).cast("long") for c in names]).repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _cells(late: DataFrame) -> DataFrame:
    """The rows of long keys (key, id, left, …; those of both sides are taken apart), in blocks of a side; each in the cells of its block with every block of the other side,
    which become the ``key``."""
    late = late.withColumn("left", F.explode(F.when(F.col("left") == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.array("left"))))
    sizes = late.groupBy("key").agg(*[F.ceil(F.count_if(F.col("left") == k) / F.lit(BLOCK)).cast("long").alias(n) for k, n in ((0, "right_blocks"), (2, "left_blocks"))])
    cut = late.join(small_side(materialise(sizes.where("right_blocks > 0 and left_blocks > 0"))), "key")
    is_left = F.col("left") == 2
    own, other = F.when(is_left, F.col("left_blocks")).otherwise(F.col("right_blocks")), F.when(is_left, F.col("right_blocks")).otherwise(F.col("left_blocks"))
    each = cut.withColumn("block", F.pmod(F.xxhash64("id"), own)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), other - 1)))
    cell = F.xxhash64("key", F.when(is_left, F.col("block")).otherwise(F.col("other")), F.when(is_left, F.col("other")).otherwise(F.col("block")))
    return each.withColumn("cell", cell).drop("key").withColumnRenamed("cell", "key")


def _both_sides(late: DataFrame) -> DataFrame:
    """For pairs of other roots: all rows to the right, and to the left those without the most frequent root of the key."""
    often = late.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("often"))
    others = late.join(small_side(materialise(often)), "key").where("root <> often").drop("often")
    return late.withColumn("left", F.lit(0).cast("long")).unionByName(others.withColumn("left", F.lit(2).cast("long")))


def _by_key(rows: DataFrame, names: list[str], pairs: Callable[[list[np.ndarray], bool], Pairs], two_sided: bool) -> DataFrame:
    """Distinct pairs (a, b) that ``pairs`` finds in the rows of each key, materialised."""
    found = materialise(_stream(rows, names, pairs, False))
    direct = found.where("a is not null").select("a", "b")
    late = found.where("a is null").select(*[F.col(f"_{n}").alias(n) for n in names])
    if late.head(1):
        late = late.distinct()
        sides = late if two_sided else _both_sides(late)
        direct = direct.unionAll(_stream(_cells(sides), names if two_sided else [*names, "left"], pairs, True).select("a", "b"))
    out = materialise(direct.distinct())
    discard(rows.sparkSession, [found])
    return out


def two_sided_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a < b) of the ids of a left (2) and a right (0) row with equal keys, from rows (key, id, left); 1 is a row of both sides."""
    return _by_key(rows, ["key", "id", "left"], _two_sides, True)


def one_sided_pairs(rows: DataFrame, payload: list[str], accept: Accept) -> DataFrame:
    """Pairs (a < b) of ids with equal keys, other roots and payloads that ``accept`` takes, from rows (key, id, root, payload…).

    Keys whose rows have one root are left out before anything is exchanged."""
    mixed = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    return _by_key(rows.join(mixed, "key"), ["key", "id", "root", *payload], _one_side(accept), False)
