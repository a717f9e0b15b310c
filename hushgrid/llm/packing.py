"""Best-fit packing by sum of squares.

Each document goes where the sum of squared counts of open bins, by residual gap, becomes smallest: for a document of size s,
moving a bin from gap g to g - s changes the sum by 2 (N(g - s) - N(g)) + 2, closing a bin of gap s by 1 - 2 N(s), opening one by
2 N(C - s) + 1. Documents are packed in doc_id order within shards of about SHARD_ROWS documents, a shard being a hash range of doc_id
and size, so the result depends on the documents alone. The bins that shards leave open then go up a tree: a node takes from
FAN_IN shards one open bin of each gap and packs these, the fullest first, by the same rule, and hands up one of each gap that is
still open. So bins cross shards, and no node holds more than FAN_IN * C bins; a bin that isn't handed up stays as it is.

Defined cases: a document longer than a bin is cut; its full pieces close a bin each and the rest is packed; a null or empty
text takes no room and has no row; rows without doc_id are packed like others, after them; repeated rows are packed as often as
they occur, thousands of them over several shards; ties go to the fullest bin, then to the bin opened first; an empty table gives an empty
result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_batches, materialise, small_side

CAPACITY = 2048
SHARD_ROWS = 50_000
FAN_IN = 16
#: Equal rows that go to one shard.
SLICE = 1000
_MOVES = "open boolean, node long, shard long, bin long, to_shard long, to_bin long, by long, slots int"
PACKED = "shard long, bin long, slot int, doc_id long, piece int, start long, n_tokens long, offset long"
#: One token separates documents in a bin.
SEPARATOR = 1


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given. Sizes are from 1 to ``capacity``."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; 0 and capacity stay 0
    bins: list[deque[int]] = [deque() for _ in range(capacity + 1)]
    where, offset, n = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for k, s in enumerate(sizes.tolist()):
        change = 2 * (count[: capacity - s + 1] - count[s:]) + 2  # at i: a bin of gap s + i
        change[0] = 1 - 2 * count[s]
        if s < capacity:
            change[-1] = 2 * count[capacity - s] + 1  # a new bin has gap C
        else:
            change[0] = 0
        gaps = np.where(count[s:] > 0, change, np.iinfo(np.int64).max)
        gaps[-1] = change[-1]
        g = s + int(gaps.argmin())
        if g == capacity:
            b, n = n, n + 1
        else:
            b = bins[g].popleft()
            count[g] -= 1
        where[k], offset[k] = b, capacity - g
        if g > s:
            bins[g - s].append(b)
            count[g - s] += 1
    return where, offset


def share_open_bins(packed: DataFrame, capacity: int, shards: int) -> DataFrame:
    """The same pieces, with open bins of several shards packed into one another."""

    def run(group: pa.Table) -> pa.Table:
        order = np.lexsort([group[c].to_numpy() for c in ("bin", "shard")] + [-group["used"].to_numpy()])
        shard, bin_, used, slots = (group[c].to_numpy()[order] for c in ("shard", "bin", "used", "slots"))
        where, offset = sum_of_squares(used, capacity)
        by = np.lexsort((offset, where))
        first = np.flatnonzero(np.concatenate([[True], where[by][1:] != where[by][:-1]]))
        host = np.empty(len(by), np.int64)
        host[by] = np.repeat(by[first], np.diff(np.append(first, len(by))))
        before = np.cumsum(slots[by]) - slots[by]
        slot = np.empty(len(by), np.int64)
        slot[by] = before - np.repeat(before[first], np.diff(np.append(first, len(by))))
        full, count = np.add.reduceat(used[by], first), np.add.reduceat(slots[by], first)
        hosts = by[first]
        up = np.flatnonzero(full < capacity)
        up = up[np.unique(full[up], return_index=True)[1]]  # one of each gap
        moved = np.flatnonzero(host != np.arange(len(by)))
        here, there = np.concatenate([moved, hosts[up]]), np.concatenate([host[moved], hosts[up]])
        return pa.table(
            {"open": np.arange(len(here)) >= len(moved), "node": np.full(len(here), group["node"][0].as_py()), "shard": shard[here], "bin": bin_[here], "to_shard": shard[there], "to_bin": bin_[there], "by": np.concatenate([offset[moved], full[up]]), "slots": np.concatenate([slot[moved], count[up]]).astype(np.int32)}
        )

    bins = packed.groupBy("shard", "bin").agg(F.sum(F.col("n_tokens") + SEPARATOR).alias("used"), F.count("*").cast("int").alias("slots")).where(F.col("used") < capacity)
    level = bins.groupBy("shard", "used").agg(F.min(F.struct("bin", "slots")).alias("b")).select("shard", "b.bin", "used", "b.slots", F.col("shard").alias("node"))
    nodes = shards
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        level = level.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
        out = materialise(level.groupBy("node").applyInArrow(run, _MOVES))
        level = out.where("open").select("node", "shard", "bin", F.col("by").alias("used"), "slots")
        moves = small_side(out.where("not open").select("shard", "bin", "to_shard", "to_bin", "by", "slots"))
        joined = packed.join(moves, ["shard", "bin"], "left")
        packed = joined.select(F.coalesce("to_shard", "shard").alias("shard"), F.coalesce("to_bin", "bin").alias("bin"), (F.col("slot") + F.coalesce("slots", F.lit(0))).alias("slot"), "doc_id", "piece", "start", "n_tokens", (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
    return packed


def lengths(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id and exact number of tokens of each row; no shuffle."""
    arrow_batches(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bpe.token_counts(raw.value, batch.column(1)))], names=["doc_id", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, n_tokens long")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary_path: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each packed piece: bin (named by the shard that opened it) and slot in it, doc_id, piece number, first token in the document, tokens, offset in the bin."""
    if capacity < 2:
        raise ValueError("a bin holds a token and a separator at least")
    shards = max(1, -(-docs.count() // shard_rows))
    equal = lengths(docs, vocabulary_path).where("n_tokens > 0").groupBy("doc_id", "n_tokens").agg(F.count("*").alias("rows"))  # before the shuffle: no shard for a hot doc_id
    cut = equal.select("doc_id", "n_tokens", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(SLICE).cast("long"))).alias("from"))
    rows = cut.select("doc_id", "n_tokens", F.least(F.lit(SLICE), F.col("rows") - F.col("from")).alias("rows"), F.pmod(F.xxhash64("doc_id", "n_tokens", "from"), F.lit(shards)).alias("shard"))

    def run(group: pa.Table) -> pa.Table:
        shard, null = group["shard"][0].as_py(), np.asarray(group["doc_id"].combine_chunks().is_null())
        ids, n = np.asarray(group["doc_id"].combine_chunks().fill_null(0)), group["n_tokens"].to_numpy()
        order = np.lexsort((n, ids, null))
        order = np.repeat(order, group["rows"].to_numpy()[order])
        ids, n, null = ids[order], n[order], null[order]
        room = capacity - SEPARATOR
        pieces = -(-n // room)
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(room, n[doc] - piece * room)
        where, offset = sum_of_squares(size + SEPARATOR, capacity)
        by = np.lexsort((offset, where))
        first = np.concatenate([[True], where[by][1:] != where[by][:-1]]) if len(by) else np.empty(0, bool)
        slot = np.empty(len(by), np.int32)
        slot[by] = np.arange(len(by)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(by) else 0
        return pa.table({"shard": pa.array(np.full(len(doc), shard)), "bin": where, "slot": slot, "doc_id": pa.array(ids[doc], mask=null[doc]), "piece": piece.astype(np.int32), "start": piece * room, "n_tokens": size, "offset": offset})

    packed = rows.groupBy("shard").applyInArrow(run, PACKED)
    return packed if shards == 1 else share_open_bins(materialise(packed), capacity, shards)
