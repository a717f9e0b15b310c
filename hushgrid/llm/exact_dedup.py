"""Exact dedup by a tree-merge of sorted digest runs.

Every text becomes an entry: 64-bit digest, SHA-256, byte length, doc_id. Entries are split into digest ranges; of each range, a
partition makes a run, sorted by digest. In the first round the runs of a range go to LEAVES nodes, in each further one FAN_IN runs go
to a node. A node merges its runs, which stay sorted, two at a time, the shortest first, and keeps, for equal digests that SHA-256
and length verify, the smallest doc_id. The rounds move entries of some 80 bytes, never texts; a partition sends one entry for each
text that it has, and the number of ranges grows with the input, so that no node holds more than about RANGE_ROWS entries.

Defined cases: a null text equals nothing, the row stays; empty texts are equal; texts of any length are hashed whole; a null doc_id comes
after all others; of repeated rows (same doc_id, same text) one stays; an empty table gives an empty result; other columns, whatever their
names, only break ties.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, small_side

LEAVES = 16
FAN_IN = 4
RANGE_ROWS = 200_000
#: Entries that a partition gathers before it sends its runs.
GATHERED = 1 << 18
_KINDS = {"digest": np.int64, "sha": np.dtype((np.uint64, 4)), "size": np.int64, "null": np.bool_, "doc_id": np.int64, "row": np.int64, "n": np.int64, "same": np.int64}
RUN = "part int, node int, " + ", ".join(f"{c} binary" for c in _KINDS)
_RUN_ARROW = pa.schema([("part", pa.int32()), ("node", pa.int32()), *((c, pa.binary()) for c in _KINDS)])
ENTRY = "digest long, sha binary, size long, doc_id long, row long, n long, same long"
Run = dict[str, np.ndarray]


def merged_order(digests: list[np.ndarray]) -> np.ndarray:
    """The order that merges ascending arrays, given one after another: the two shortest ones first, equal digests in any order."""
    start, todo = 0, []
    for k, d in enumerate(digests):
        todo.append((len(d), k, d, np.arange(start, start + len(d))))
        start += len(d)
    heapq.heapify(todo)
    while len(todo) > 1:
        (n, k, d, i), (m, _, e, j) = heapq.heappop(todo), heapq.heappop(todo)
        at = np.searchsorted(d, e, "right") + np.arange(m)
        other = np.ones(n + m, bool)
        other[at] = False
        both, index = np.empty(n + m, np.int64), np.empty(n + m, np.int64)
        both[at], both[other], index[at], index[other] = e, d, j, i
        heapq.heappush(todo, (n + m, k, both, index))
    return todo[0][3] if todo else np.empty(0, np.int64)


def settle(run: Run) -> Run:
    """Of entries by ascending digest, one for each verified text, of the smallest doc_id (null last) and row. ``n`` counts the rows of the text,
    ``same`` those of the kept doc_id and row."""
    d = run["digest"]
    if not len(d):
        return run
    start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    size = np.diff(np.append(start, len(d)))
    several = np.flatnonzero(np.repeat(size > 1, size))  # the rest is alone with its digest
    if not len(several):
        return run
    sub = {c: x[several] for c, x in run.items()}
    order = several[np.lexsort((sub["row"], sub["doc_id"], sub["null"], sub["size"], *sub["sha"].T[::-1], sub["digest"]))]
    every = np.arange(len(d))
    every[several] = order
    run = {c: x[every] for c, x in run.items()}
    new = np.concatenate([[True], (run["digest"][1:] != run["digest"][:-1]) | (run["size"][1:] != run["size"][:-1]) | (run["sha"][1:] != run["sha"][:-1]).any(1)])
    at = np.flatnonzero(new)
    head = at[np.cumsum(new) - 1]
    winner = np.logical_and.reduce([run[c] == run[c][head] for c in ("null", "doc_id", "row")])
    out = {c: x[at] for c, x in run.items()}
    out["n"], out["same"] = np.add.reduceat(run["n"], at), np.add.reduceat(np.where(winner, run["same"], 0), at)
    return out


def merge(runs: list[Run]) -> Run:
    order = merged_order([r["digest"] for r in runs])
    return settle({c: np.concatenate([r[c] for r in runs])[order] for c in _KINDS})


def _rows(runs: list[tuple[int, int, Run]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in runs], pa.int32()), pa.array([k for _, k, _ in runs], pa.int32()), *(pa.array([np.ascontiguousarray(r[c]).tobytes() for _, _, r in runs], pa.binary()) for c in _KINDS)], schema=_RUN_ARROW)


def _read(table: pa.Table | pa.RecordBatch) -> list[Run]:
    return [{c: np.frombuffer(table[c][i].as_buffer(), kind) for c, kind in _KINDS.items()} for i in range(table.num_rows)]


def merge_node(group: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_rows([(group["part"][0].as_py(), group["node"][0].as_py(), merge(_read(group)))])])


def digests(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("digest"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.octet_length(text).cast("long").alias("size")]


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[docs[c] for c, k in docs.dtypes if "map<" not in k and k not in ("variant", "void")])


def survivors(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """One entry for each text: digest, sha, size, the smallest doc_id with its row hash, and how many rows have the text (``n``) and are the same row (``same``)."""
    ranges = max(1, -(-docs.count() // RANGE_ROWS))
    entries = docs.where(docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), (F.lit(0) if row is None else row).cast("long").alias("row"), *digests(docs["text"]))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = TaskContext.get().partitionId() % LEAVES, []

        def send() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            null = np.asarray(t["doc_id"].combine_chunks().is_null())
            run = {"digest": t["digest"].to_numpy(), "sha": np.frombuffer(b"".join(t["sha"].to_pylist()), np.uint64).reshape(-1, 4), "size": t["size"].to_numpy(), "null": null, "doc_id": np.asarray(t["doc_id"].combine_chunks().fill_null(0)), "row": t["row"].to_numpy()}
            run["n"] = run["same"] = np.ones(len(null), np.int64)
            part = run["digest"] % ranges
            order = np.lexsort((run["digest"], part))
            at = np.searchsorted(part[order], np.arange(ranges + 1))
            runs = [(k, node, settle({c: x[order[p:q]] for c, x in run.items()})) for k, (p, q) in enumerate(zip(at[:-1], at[1:], strict=True)) if q > p]
            if runs:
                yield _rows(runs)

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= GATHERED:
                yield from send()
                held, n = [], 0
        if n:
            yield from send()

    def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _read(batch):
                for a in range(0, len(r["digest"]), 1 << 14):
                    x = {c: v[a : a + (1 << 14)] for c, v in r.items()}
                    sha = [k.tobytes() for k in x["sha"]]
                    yield pa.RecordBatch.from_arrays([pa.array(x["digest"]), pa.array(sha, pa.binary()), pa.array(x["size"]), pa.array(x["doc_id"], mask=x["null"]), *(pa.array(x[c]) for c in ("row", "n", "same"))], names=["digest", "sha", "size", "doc_id", "row", "n", "same"])

    run, nodes = entries.mapInArrow(leaves, RUN), LEAVES
    while True:
        run = run.groupBy("part", "node").applyInArrow(merge_node, RUN)
        if nodes == 1:
            return run.mapInArrow(entries_of, ENTRY)
        nodes = -(-nodes // FAN_IN)
        run = run.withColumn("node", (F.col("node") / FAN_IN).cast("int"))


def copies(docs: DataFrame) -> DataFrame:
    """A row for each document row: doc_id is the kept document; copy_id the copy of it that goes, null for the kept one itself."""
    docs = docs.select("doc_id", "text")
    kept = materialise(survivors(docs))
    groups = kept.where("n > 1")
    groups = small_side(groups.select("digest", "sha", "size", F.col("doc_id").alias("keep")))
    entries = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("copy_id"), *digests(F.col("text")))
    gone = entries.join(groups, ["digest", "sha", "size"]).where(~F.col("copy_id").eqNullSafe(F.col("keep"))).select(F.col("keep").alias("doc_id"), "copy_id")
    again = kept.where("same > 1").select("doc_id", F.explode(F.sequence(F.lit(2).cast("long"), "same"))).select("doc_id", F.col("doc_id").alias("copy_id"))
    alone = lambda df: df.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("copy_id"))
    return alone(kept).unionAll(gone).unionAll(again).unionAll(alone(docs.where(F.col("text").isNull())))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs without the copies, all columns unchanged. Of each text the row of the smallest doc_id stays; of the same doc_id, the one with the smallest row hash."""
    kept = materialise(survivors(docs, row_hash(docs)).where("n > 1"))
    names = {c: fresh(docs.columns, c) for c in ("digest", "sha", "size", "keep", "keep_row", "same", "own_row")}
    groups = small_side(kept.select(*[F.col(c).alias(names[c]) for c in ("digest", "sha", "size")], F.col("doc_id").alias(names["keep"]), F.col("row").alias(names["keep_row"]), F.col("same").alias(names["same"])))
    on = [names[c] for c in ("digest", "sha", "size")]
    keyed = docs.withColumns({**{names[c]: x for c, x in zip(("digest", "sha", "size"), digests(docs["text"]), strict=True)}, names["own_row"]: row_hash(docs)})
    found = keyed.withColumn(on[1], F.when(docs["text"].isNotNull(), F.col(on[1]))).join(groups, on, "left")
    single = F.col(names["same"]).isNull()
    winner = docs["doc_id"].cast("long").eqNullSafe(F.col(names["keep"])) & (F.col(names["own_row"]) == F.col(names["keep_row"]))
    out = found.where(single | (winner & (F.col(names["same"]) == 1))).select(*[docs[c] for c in docs.columns])
    if not kept.where("same > 1").head(1):
        return out
    repeated = found.where(~single & winner & (F.col(names["same"]) > 1)).dropDuplicates(on).select(*docs.columns)
    return out.unionAll(repeated)
