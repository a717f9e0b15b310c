"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a tree hold ``rank << bits | position`` of each adjacent pair; its root is the leftmost pair of lowest rank.
A merge updates three leaves and their ancestors. Pieces of up to ``WIDE`` bytes are merged many at a time, one numpy row
a piece; longer ones get a tree of their own. Equal pieces of a chunk are encoded once.

Defined cases: a null text has null ids; an empty text has no ids; any text round-trips, texts and words of any length are encoded whole;
of equal ranks the leftmost pair is merged; repeated rows are encoded alike; an empty table gives an empty result; other columns, whatever
their names, aren't read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textkern as tk
from .common import arrow_batches

WIDE = 128
NONE = np.int64(1) << 62
#: Pieces kept between chunks by a worker; only speed depends on it.
CACHED = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_vocabulary(path: str | None = None) -> bytes:
    with open(path or default_vocabulary(), "rb") as f:
        return f.read()


class Vocabulary:
    """Tokens by rank, with the merge table as sorted keys. A rank file has one ``base64 rank`` pair a line."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for t, r in ranks.items():
            self.tokens[r] = t
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.pool = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.length, self.start = lengths, np.cumsum(lengths) - lengths
        keys, vals = [], []
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    vals.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.pairs = dict(zip(keys, vals, strict=True))
        self.lookup = HashTable(np.array(keys, np.int64)[order], np.array(vals, np.int64)[order])

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, -1 if there is none."""
        return self.lookup.get(a.astype(np.int64) * self.size + b)


class HashTable:
    """Distinct non-negative int64 keys to int64 values, read many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        n = 1 << self.bits
        self.keys, self.values = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        left, shift = np.arange(len(keys)), 0
        while len(left):
            slot = (self._slot(keys[left]) + shift) & (n - 1)
            free = self.keys[slot] < 0
            cand, slots = left[free], slot[free]
            slots, first = np.unique(slots, return_index=True)
            self.keys[slots], self.values[slots] = keys[cand[first]], values[cand[first]]
            placed = np.zeros(len(keys), bool)
            placed[cand[first]] = True
            left = left[~placed[left]]
            shift += 1
        self.probes = max(1, shift)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        mask = len(self.keys) - 1
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        for shift in range(1, self.probes):
            if not len(left):
                break
            s = (slot[left] + shift) & mask
            found = self.keys[s]
            hit = found == keys[left]
            out[left[hit]] = self.values[s[hit]]
            left = left[~hit & (found >= 0)]
        return out


@functools.lru_cache(2)
def vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def merge_rows(v: Vocabulary, data: np.ndarray, start: np.ndarray, length: np.ndarray, n: int, last: bool = False):
    """Encode pieces of at most ``n`` bytes (a power of 2), a row each. Returns ids (rows x n, -1 where none);
    with ``last``, instead the two ids of each row's last merge."""
    rows, bits = len(start), n.bit_length() - 1
    col = np.arange(n)
    inside = col < length[:, None]
    ids = np.where(inside, v.byte[data[np.minimum(start[:, None] + col, max(0, len(data) - 1))]], -1).astype(np.int32)
    tree = np.full((rows, 2 * n), NONE, np.int64)
    if n > 1:
        r = v.rank(np.maximum(ids[:, :-1], 0).ravel(), np.maximum(ids[:, 1:], 0).ravel()).reshape(rows, n - 1)
        tree[:, n : 2 * n - 1] = np.where((r >= 0) & inside[:, 1:], (r << bits) | col[:-1], NONE)
    for lo in [n >> k for k in range(1, bits + 1)]:
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
    nxt = np.broadcast_to(np.append(col + 1, n), (rows, n + 1)).copy()
    nxt[:, :n][col + 1 >= length[:, None]] = n
    prv = np.broadcast_to(np.append(col - 1, n - 1), (rows, n + 1)).copy()
    prv[:, 0] = n + 1
    left_id, right_id = np.full(rows, -1, np.int32), np.full(rows, -1, np.int32)
    w, w1 = 2 * n, n + 1
    tf, nf, pf, idf = tree.ravel(), nxt.ravel(), prv.ravel(), ids.ravel()
    live = np.flatnonzero(tree[:, 1] < NONE)
    while len(live):
        root = tf[live * w + 1]
        pos, rank = root & (n - 1), (root >> bits).astype(np.int32)
        right = nf[live * w1 + pos]
        if last:
            left_id[live], right_id[live] = idf[live * n + pos], idf[live * n + right]
        idf[live * n + pos], idf[live * n + right] = rank, -1
        after = nf[live * w1 + right]
        nf[live * w1 + pos] = after
        pf[live * w1 + after] = pos
        before = pf[live * w1 + pos]
        tf[live * w + n + right] = NONE
        has = after < n
        r = v.rank(rank, np.where(has, idf[live * n + np.minimum(after, n - 1)], 0))
        tf[live * w + n + pos] = np.where(has & (r >= 0), (r << bits) | pos, NONE)
        has = before < n
        b = np.where(has, before, pos)
        r = v.rank(np.maximum(idf[live * n + b], 0), rank)
        old = tf[live * w + n + b]
        tf[live * w + n + b] = np.where(has, np.where(r >= 0, (r << bits) | b, NONE), old)
        base, spots = live * w, [n + right, n + pos, n + b]
        for _ in range(bits):
            spots = [s >> 1 for s in spots]
            for s in spots:
                i = base + 2 * s
                tf[base + s] = np.minimum(tf[i], tf[i + 1])
        live = live[tf[live * w + 1] < NONE]
    return (left_id, right_id) if last else ids


def merge_long(v: Vocabulary, piece: bytes) -> list[int]:
    """Encode one piece with a segment tree of its own: log n steps a merge, whatever the length."""
    m = len(piece)
    n = 1 << max(1, (m - 1).bit_length())
    bits, none = n.bit_length(), 1 << 62
    ids = [int(x) for x in v.byte[np.frombuffer(piece, np.uint8)]]
    nxt, prv = list(range(1, m + 1)), list(range(-1, m - 1))
    tree = [none] * (2 * n)
    get, size = v.pairs.get, v.size
    for i in range(m - 1):
        r = get(ids[i] * size + ids[i + 1])
        if r is not None:
            tree[n + i] = r << bits | i
    for i in range(n - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, x: int) -> None:
        i += n
        tree[i] = x
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            x = a if a < b else b
            if tree[i] == x:
                break
            tree[i] = x

    while tree[1] < none:
        pos, rank = tree[1] & ((1 << bits) - 1), tree[1] >> bits
        right = nxt[pos]
        after = nxt[right]
        ids[pos], ids[right], nxt[pos] = rank, -1, after
        put(right, none)
        r = get(rank * size + ids[after]) if after < m else None
        put(pos, none if r is None else r << bits | pos)
        if after < m:
            prv[after] = pos
        before = prv[pos]
        if before >= 0:
            r = get(ids[before] * size + rank)
            put(before, none if r is None else r << bits | before)
    return [x for x in ids if x >= 0]


def encode_pieces(v: Vocabulary, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in one array, and the number of each piece's ids."""
    counts = np.zeros(len(start), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = 1
    while size <= WIDE:
        rows = np.flatnonzero((length <= size) & (length > (size >> 1)))
        for block in np.array_split(rows, max(1, len(rows) * size // (1 << 19))) if len(rows) else ():
            ids = merge_rows(v, data, start[block], length[block], size)
            keep = ids >= 0
            counts[block] = keep.sum(1)
            parts.append((block, ids[keep]))
        size *= 2
    for i in np.flatnonzero(length > WIDE):
        ids = np.array(merge_long(v, data[start[i] : start[i] + length[i]].tobytes()), np.int32)
        counts[i] = len(ids)
        parts.append((np.array([i]), ids))
    first = np.cumsum(counts) - counts
    pool = np.empty(int(counts.sum()), np.int32)
    for block, ids in parts:
        pool[tk.ragged(first[block], counts[block])] = ids
    return pool, counts


class Encoder:
    """Encodes chunks; keeps the pieces of earlier chunks by a 64-bit hash, checked by a second one."""

    def __init__(self, raw: bytes):
        self.v = vocabulary(raw)
        self._clear()

    def _clear(self) -> None:
        self.hash, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.first, self.count, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def pieces(self, t: tk.Text) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces and, for each, its row in the kept pieces."""
        s = tk.pretokens(t)
        e = np.append(s[1:], len(t.cp))
        code = tk.tables()["code"][t.cp]
        h, h2 = tk.segment_hash(code, s, e, check=True)
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        if (h2 != h2[at][back]).any():
            raise ValueError("two pieces with equal 64-bit hashes")
        if len(self.hash) > CACHED:
            self._clear()
        where = np.searchsorted(self.hash, u)
        known = where < len(self.hash)
        known[known] = self.hash[where[known]] == u[known]
        if (self.check[where[known]] != h2[at[known]]).any():
            raise ValueError("two pieces with equal 64-bit hashes")
        new = at[~known]
        if len(new):
            b = t.byte
            pool, counts = encode_pieces(self.v, t.data, b[s[new]], b[e[new]] - b[s[new]])
            first = len(self.pool) + np.cumsum(counts) - counts
            self.pool = np.concatenate([self.pool, pool])
            to = where[~known]
            self.hash, self.check = np.insert(self.hash, to, u[~known]), np.insert(self.check, to, h2[new])
            self.first, self.count = np.insert(self.first, to, first), np.insert(self.count, to, counts)
        return s, np.searchsorted(self.hash, u)[back]

    def encode(self, t: tk.Text) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each text's ids."""
        n = len(t.at) - 1
        if not len(t.cp):
            return np.empty(0, np.int32), np.zeros(n + 1, np.int64)
        s, row = self.pieces(t)
        ids = self.pool[tk.ragged(self.first[row], self.count[row])]
        total = np.concatenate([[0], np.cumsum(self.count[row])])
        return ids, total[np.searchsorted(s, t.at)]

    def counts(self, t: tk.Text) -> np.ndarray:
        if not len(t.cp):
            return np.zeros(len(t.at) - 1, np.int64)
        s, row = self.pieces(t)
        return np.diff(np.concatenate([[0], np.cumsum(self.count[row])])[np.searchsorted(s, t.at)])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts, and their offsets."""
        n = self.v.length[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.v.pool[tk.ragged(self.v.start[ids], n)], total[offsets]


@functools.lru_cache(2)
def encoder(raw: bytes) -> Encoder:
    return Encoder(raw)


def token_counts(raw: bytes, column: pa.Array) -> np.ndarray:
    """Number of tokens of each text of an Arrow column."""
    enc, (data, off) = encoder(raw), tk.utf8(column)
    out = np.zeros(len(off) - 1, np.int64)
    for a, b in tk.chunks(off):
        out[a:b] = enc.counts(tk.Text(data[off[a] : off[b]], off[a : b + 1]))
    return out


ENCODED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("round_trip", T.BooleanType())]
)


def encode(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes and whether the ids decode to the same bytes; a row for each row, no shuffle.

    A null text gives nulls, an empty text no ids. Other columns aren't read."""
    arrow_batches(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in batches:
            column = batch.column(1)
            data, off = tk.utf8(column)
            for a, b in tk.chunks(off):
                t = tk.Text(data[off[a] : off[b]], off[a : b + 1])
                ids, to = enc.encode(t)
                back, at = enc.decode(ids, to)
                null = np.array(column.slice(a, b - a).is_null())
                starts = off[a : b + 1] - off[a]
                same = np.array([np.array_equal(back[at[i] : at[i + 1]], data[off[a] + starts[i] : off[a] + starts[i + 1]]) for i in range(b - a)])
                lists = pa.ListArray.from_arrays(pa.array(to.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), lists, pa.array(np.diff(to), mask=null), pa.array(np.diff(starts), mask=null), pa.array(same, mask=null)], schema=schema
                )

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("round_trip", pa.bool_())])
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id and the text of each row's ``ids``; null ids give a null text, no ids an empty one. Unknown ids are an error."""
    arrow_batches(encoded.sparkSession)
    raw = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in batches:
            lists = batch.column(1)
            null = np.array(lists.is_null())
            lengths = np.array(lists.value_lengths().fill_null(0), np.int64)
            ids = np.array(lists.flatten(), np.int64)
            back, at = enc.decode(ids, np.concatenate([[0], np.cumsum(lengths)]))
            raw_ = back.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x else raw_[at[i] : at[i + 1]].decode("utf-8", "replace") for i, x in enumerate(null)], pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded["doc_id"].cast("long"), encoded["ids"].cast("array<int>")).mapInArrow(run, "doc_id long, text string")
