"""Token counts by prefix dynamic programming.

For each text the exact number of tokens of every prefix is stored, so truncation and budget questions need no encoding. Within a
piece of the token pattern, the last token of the prefix ending at byte i is the only token t whose predecessor prefix ends
with a token that t may follow, so ``count[i] = count[i - len(t)] + 1``. A pair may be adjacent if the encoder would not merge
across its border; that is decided by undoing the merges of both tokens. Across pieces counts add up; a cut inside blanks or a
contraction changes the pieces, and these prefixes are counted as they would be split.

Counts aren't monotone: a further character can complete a longer token. A budget question is answered with the longest prefix within
the budget.

Defined cases: a null text gives nulls; an empty text has no prefix and no token; texts of any length are counted whole;
of several prefixes within a budget the longest is taken; repeated rows are counted alike; an empty table gives an empty result; other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from . import textkern as tk
from .common import arrow_batches

BUDGETS = (512, 1024, 2048, 4096, 8192)
COUNTED = "doc_id long, n_chars long, n_tokens long, width int, deltas binary, " + ", ".join(f"chars_{b} long" for b in BUDGETS)


class Prefixes:
    """Tables of a vocabulary: the merge each token comes from, the merges by pair, and a trie of the tokens."""

    def __init__(self, raw: bytes):
        self.v = v = bpe.vocabulary(raw)
        start, length = v.start, v.length
        left, right = np.arange(v.size), np.arange(v.size)
        size = 2
        while size // 2 < length.max():
            rows = np.flatnonzero((length > size // 2) & (length <= size))
            for block in np.array_split(rows, max(1, len(rows) * size // (1 << 22))) if len(rows) else ():
                left[block], right[block] = bpe.merge_rows(v, v.pool, start[block], length[block], size, last=True)
            size *= 2
        self.left, self.right = left, right
        own = np.flatnonzero((length > 1) & (left >= 0))
        self.merge = bpe.HashTable(left[own] * v.size + right[own], own)
        self.merged = dict(zip((left[own] * v.size + right[own]).tolist(), own.tolist(), strict=True))
        nodes: dict[bytes, int] = {b"": 0}
        for t in v.tokens:
            for i in range(1, len(t) + 1):
                nodes.setdefault(t[:i], len(nodes))
        keys = np.array([nodes[k[:-1]] * 256 + k[-1] for k in nodes if k], np.int64)
        self.trie = bpe.HashTable(keys, np.array([n for k, n in nodes.items() if k], np.int64))
        self.steps = dict(zip(keys.tolist(), range(1, len(nodes)), strict=True))
        self.token = np.array([v.ranks.get(k, -1) for k in nodes], np.int64)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b can follow token a in an encoding."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        out = np.ones(len(a), bool)
        left = np.arange(len(a))
        while len(left):
            x, y, lim = a[left], b[left], limit[left]
            c = self.merge.get(x * self.v.size + y)
            bad = (c >= 0) & (c < lim)
            out[left[bad]] = False
            gt = x > y
            # undo the later merge; at a single byte, the other side is undone
            up = self.right[x]
            down = self.left[y]
            base_x, base_y = up == x, down == y
            use_x = (gt & ~base_x) | (~gt & base_y & ~base_x)
            use_y = (~gt & ~base_y) | (gt & base_x & ~base_y)
            a[left[use_x]], limit[left[use_x]] = up[use_x], x[use_x]
            b[left[use_y]], limit[left[use_y]] = down[use_y], y[use_y] + 1
            left = left[~bad & (use_x | use_y)]
        return out

    def rows(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
        """Counts of the prefixes of pieces of at most n bytes: rows x (n + 1)."""
        r = len(start)
        last, count = np.full((r, n + 1), -1, np.int64), np.zeros((r, n + 1), np.int32)
        lf, cf, w = last.ravel(), count.ravel(), n + 1
        for j in range(n):
            live = np.flatnonzero(length > j)
            node = np.zeros(len(live), np.int64)
            k = 0
            while len(live):
                node = self.trie.get(node * 256 + data[start[live] + j + k])
                ok = node >= 0
                live, node = live[ok], node[ok]
                k += 1
                tok = self.token[node]
                to = live * w + j + k
                cand = np.flatnonzero((tok >= 0) & (lf[to] < 0))
                if j and len(cand):
                    cand = cand[self.fits(lf[live[cand] * w + j], tok[cand])]
                lf[to[cand]] = tok[cand]
                cf[to[cand]] = cf[live[cand] * w + j] + 1
                more = length[live] > j + k
                live, node = live[more], node[more]
        return count

    def fits_one(self, a: int, b: int) -> bool:
        limit, size = 1 << 62, self.v.size
        while True:
            c = self.merged.get(a * size + b)
            if c is not None and c < limit:
                return False
            up, down = int(self.right[a]), int(self.left[b])
            if (a > b and up != a) or (a <= b and down == b and up != a):
                a, limit = up, a
            elif down != b:
                b, limit = down, b + 1
            else:
                return True

    def long(self, piece: bytes) -> np.ndarray:
        """The same for one piece of any length."""
        n, step, token = len(piece), self.steps.get, self.token.tolist()
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for j in range(n):
            node, i, before, c = 0, j, last[j], count[j] + 1
            while i < n and (node := step(node * 256 + piece[i])) is not None:
                i += 1
                t = token[node]
                if t >= 0 and last[i] < 0 and (j == 0 or self.fits_one(before, t)):
                    last[i], count[i] = t, c
        return np.array(count, np.int32)


class Counter:
    """Prefix counts of chunks of texts; keeps the pieces of earlier chunks."""

    def __init__(self, raw: bytes):
        self.p = Prefixes(raw)
        self._clear()

    def _clear(self) -> None:
        self.hash, self.check, self.first, self.pool = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)

    def pieces(self, t: tk.Text, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By piece one after another, the counts after each of its characters; and where each piece's counts begin."""
        byte, n_chars = t.byte, e - s
        length = byte[e] - byte[s]
        first = np.cumsum(n_chars) - n_chars
        pool = np.empty(int(n_chars.sum()), np.int32)
        lead = np.zeros(len(t.data) + 1, bool)
        lead[byte[1:]] = True  # a character ends before these bytes
        size = 1
        while size <= bpe.WIDE:
            rows = np.flatnonzero((length <= size) & (length > size >> 1))
            for block in np.array_split(rows, max(1, len(rows) * size // (1 << 18))) if len(rows) else ():
                counts = self.p.rows(t.data, byte[s[block]], length[block], size)[:, 1:]
                col = np.arange(1, size + 1)
                at = np.minimum(byte[s[block]][:, None] + col, len(t.data))
                pool[tk.ragged(first[block], n_chars[block])] = counts[lead[at] & (col <= length[block][:, None])]
            size *= 2
        for i in np.flatnonzero(length > bpe.WIDE):
            a, b = byte[s[i]], byte[e[i]]
            pool[first[i] : first[i] + n_chars[i]] = self.p.long(t.data[a:b].tobytes())[1:][lead[a + 1 : b + 1]]
        cut = (n_chars == 3) & (t.cp[s] == 39)
        cut[cut] = tk.tables()["cls"][t.cp[s[cut] + 1]] == tk.LETTER  # 'll, 've and 're; before their last letter it is an apostrophe and a letter
        pool[first[cut] + 1] = 2
        return pool, first

    def counts(self, t: tk.Text) -> np.ndarray:
        """Tokens of the prefix up to and with each character, of its text."""
        if not len(t.cp):
            return np.empty(0, np.int64)
        s = tk.pretokens(t)
        e = np.append(s[1:], len(t.cp))
        h, h2 = tk.segment_hash(tk.tables()["code"][t.cp], s, e, check=True)
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) > bpe.CACHED // 2:
            self._clear()
        where = np.searchsorted(self.hash, u)
        known = where < len(self.hash)
        known[known] = self.hash[where[known]] == u[known]
        if (h2 != h2[at][back]).any() or (self.check[where[known]] != h2[at[known]]).any():
            raise ValueError("two pieces with equal 64-bit hashes")
        new = at[~known]
        if len(new):
            pool, first = self.pieces(t, s[new], e[new])
            to = where[~known]
            self.hash, self.check, self.first = np.insert(self.hash, to, u[~known]), np.insert(self.check, to, h2[new]), np.insert(self.first, to, len(self.pool) + first)
            self.pool = np.concatenate([self.pool, pool])
        first = self.first[np.searchsorted(self.hash, u)[back]]
        out = self.pool[tk.ragged(first, e - s)].astype(np.int64)
        full = out[e - 1]  # of whole pieces
        total = np.concatenate([[0], np.cumsum(full)])
        text = np.searchsorted(t.at, s, "right") - 1
        begin = total[np.searchsorted(s, t.at)]
        base = total[:-1] - begin[text]
        out += np.repeat(base, e - s)
        blank = tk.tables()["cls"][t.cp[s]] == tk.SPACE
        split = np.flatnonzero(blank[:-1] & blank[1:] & (text[:-1] == text[1:]))  # blanks, then a blank that goes with the next piece
        if len(split):
            b = t.byte
            _, n = bpe.encode_pieces(self.p.v, t.data, b[s[split]], b[s[split + 1] + 1] - b[s[split]])
            out[s[split + 1]] = base[split] + n
        return out


@functools.lru_cache(2)
def counter(raw: bytes) -> Counter:
    return Counter(raw)


def count(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, characters, tokens, the prefix counts as differences of ``width`` bytes each, and for each budget the characters of the longest prefix within it. No shuffle."""
    arrow_batches(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(raw.value)
        for batch in batches:
            column = batch.column(1)
            data, off = tk.utf8(column)
            for a, b in tk.chunks(off):
                t = tk.Text(data[off[a] : off[b]], off[a : b + 1])
                n, at = c.counts(t), t.at
                null = np.array(column.slice(a, b - a).is_null())
                chars = np.diff(at)
                tokens = np.where(chars > 0, n[np.maximum(at[1:] - 1, 0)] if len(n) else 0, 0)
                step = np.diff(n, prepend=0)
                step[at[:-1][chars > 0]] = n[at[:-1][chars > 0]]
                width, stored = np.ones(b - a, np.int32), []
                for i, (p, q) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    x = step[p:q]
                    if q > p and np.abs(x).max() > 127:
                        width[i] = 4
                    stored.append(x.astype(np.int8 if width[i] == 1 else np.int32).tobytes())
                cuts = []
                for budget in BUDGETS:
                    cut = chars.copy()
                    for i in np.flatnonzero(tokens > budget - 128):
                        inside = np.flatnonzero(n[at[i] : at[i + 1]] <= budget)
                        cut[i] = inside[-1] + 1 if len(inside) else 0
                    cuts.append(cut)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(chars, mask=null), pa.array(tokens, mask=null), pa.array(width, mask=null), pa.array([None if z else x for x, z in zip(stored, null, strict=True)], pa.binary()), *(pa.array(x, mask=null) for x in cuts)],
                    names=["doc_id", "n_chars", "n_tokens", "width", "deltas", *(f"chars_{x}" for x in BUDGETS)],
                )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, COUNTED)


def _prefixes(deltas: pd.Series, width: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The prefix counts of all rows one after another, each row's beginning with 0, and where the rows begin."""
    flat, at = [], np.zeros(len(deltas) + 1, np.int64)
    bits = width.fillna(1).to_numpy(np.int64)
    n = np.fromiter((0 if d is None else len(d) for d in deltas), np.int64, len(deltas)) // bits + 1
    np.cumsum(n, out=at[1:])
    flat = np.zeros(int(at[-1]), np.int64)
    for w, kind in ((1, np.int8), (4, np.int32)):
        rows = np.flatnonzero((bits == w) & (n > 1))
        flat[tk.ragged(at[rows] + 1, n[rows] - 1)] = np.frombuffer(b"".join(deltas.iloc[rows]), kind)
    total = np.cumsum(flat)
    return total - np.repeat(total[at[:-1]], n), at


@F.pandas_udf(T.LongType())
def _tokens_at(deltas: pd.Series, width: pd.Series, chars: pd.Series) -> pd.Series:
    counts, at = _prefixes(deltas, width)
    k = chars.fillna(0).to_numpy(np.int64)
    return pd.Series(counts[at[:-1] + np.clip(k, 0, np.diff(at) - 1)]).mask((deltas.isna() | chars.isna()).to_numpy()).astype("Int64") if len(at) > 1 else pd.Series([], dtype="Int64")


@F.pandas_udf(T.LongType())
def _chars_within(deltas: pd.Series, width: pd.Series, budget: pd.Series) -> pd.Series:
    counts, at = _prefixes(deltas, width)
    if len(at) == 1:
        return pd.Series([], dtype="Int64")
    n = np.diff(at)
    inside = np.where(counts <= np.repeat(budget.fillna(0).to_numpy(np.int64), n), np.arange(len(counts)), 0)
    return pd.Series(np.maximum(np.maximum.reduceat(inside, at[:-1]) - at[:-1], 0)).mask((deltas.isna() | budget.isna()).to_numpy()).astype("Int64")


def tokens_at(chars: Column | int) -> Column:
    """Of a counted row: tokens of the prefix of so many characters (of the whole text, if it is shorter)."""
    return _tokens_at("deltas", "width", chars if isinstance(chars, Column) else F.lit(chars))


def chars_within(budget: Column | int) -> Column:
    """Of a counted row: characters of the longest prefix of at most so many tokens."""
    return _chars_within("deltas", "width", budget if isinstance(budget, Column) else F.lit(budget))
