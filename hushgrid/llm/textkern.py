"""Vectorised text kernels: Arrow strings to code points, segments and 64-bit segment hashes.

Everything works on whole Arrow chunks with numpy, so no Python object exists per character, word or token.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_N_POW = 1 << 16


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """By code point: class of the token pattern, word character or not, simple lower case, 64-bit code, upper case or not."""
    n = 0x110000
    cls, word, lower, upper = np.zeros(n, np.uint8), np.zeros(n, bool), np.arange(n, dtype=np.uint32), np.zeros(n, bool)
    for c in range(n):
        ch = chr(c)
        k = unicodedata.category(ch)
        if k[0] == "L":
            cls[c], word[c] = LETTER, True
            if k == "Lu" or k == "Lt":
                upper[c] = True
                low = ch.lower()
                if len(low) == 1:
                    lower[c] = ord(low)
        elif k[0] == "N":
            cls[c], word[c] = NUMBER, True
        elif k[0] == "M":
            word[c] = True
    cls[_WHITE] = SPACE
    return {"cls": cls, "word": word, "lower": lower, "upper": upper, "code": splitmix(np.arange(n, dtype=np.uint64))}


@functools.cache
def powers(base: int) -> np.ndarray:
    """The first _N_POW powers of the base modulo 2^64."""
    out = np.full(_N_POW, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def power(base: int, at: np.ndarray, most: int) -> np.ndarray:
    """base^at modulo 2^64 for exponents up to ``most``, below 2^32: beyond _N_POW, the product of two table entries."""
    if most < _N_POW:
        return powers(base)[at]
    return powers(base)[at & (_N_POW - 1)] * powers(pow(base, _N_POW, 1 << 64))[at >> 16]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and int64 offsets from 0; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 19) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        out.append((a, b))
        a = b
    return out


class Text:
    """Code points of consecutive texts: ``cp``, character offsets ``at`` and byte position ``byte`` of each character (one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lead = (data & 0xC0) != 0x80
        try:
            text = data.tobytes().decode("utf-8")
            self.cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            total = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
            self.at = total[offsets - offsets[0]]
            ok = len(self.cp) == self.at[-1]
        except UnicodeError:
            ok = False
        if not ok:  # bytes that aren't UTF-8: each text is read with replacement characters
            raw = data.tobytes()
            parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip((offsets - offsets[0])[:-1], (offsets - offsets[0])[1:], strict=True)]
            self.cp = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
            self.at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            data = np.frombuffer("".join(parts).encode("utf-8"), np.uint8)
            lead = (data & 0xC0) != 0x80
        self.data = data
        self._lead = lead

    @functools.cached_property
    def byte(self) -> np.ndarray:
        return np.append(np.flatnonzero(self._lead), len(self.data))


def runs_of(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where mask holds, never across the text offsets ``at``."""
    n = len(mask)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.concatenate([[False], mask[:-1]])
    after = np.concatenate([mask[1:], [False]])
    return np.flatnonzero(mask & (~before | cut[:n])), np.flatnonzero(mask & (~after | cut[1:])) + 1


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, check: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each non-empty segment [start, end) of the uint64 codes; the segments ascend and don't overlap.
    With ``check``, also a second one, from other codes and another base."""
    if not len(starts):
        return (np.empty(0, np.uint64),) * 2 if check else np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    n = int(first[-1] + lengths[-1])
    if n == len(values):  # they cover everything
        inner, own = np.arange(n, dtype=np.int64) - np.repeat(starts, lengths), values
    else:
        at = np.repeat(starts - first, lengths)
        at += np.arange(n, dtype=np.int64)
        inner, own = at - np.repeat(starts, lengths), values[at]
    size, most = lengths.astype(np.uint64), int(lengths.max()) - 1
    h = splitmix(np.add.reduceat(own * power(0x9E3779B97F4A7C15, inner, most), first) ^ size)
    return (h, splitmix(np.add.reduceat((own ^ (own >> np.uint64(29))) * power(0xD6E8FEB86659FD93, inner, most), first) + size)) if check else h


def words(t: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words (runs of letters, digits and marks): hash, text number, start and end in characters."""
    tab = tables()
    starts, ends = runs_of(tab["word"][t.cp], t.at)
    h = segment_hash(tab["code"][tab["lower"][t.cp]], starts, ends)
    return h, np.searchsorted(t.at, starts, "right") - 1, starts, ends


def pretokens(t: Text) -> np.ndarray:
    """Starts (in characters) of the pieces of the byte-level BPE pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    cp, n = t.cp, len(t.cp)
    if not n:
        return np.empty(0, np.int64)
    c = tables()["cls"][cp]
    edge = np.zeros(n + 1, bool)
    edge[t.at] = True
    new = edge[:n].copy()
    new[1:] |= c[1:] != c[:-1]
    rs = np.flatnonzero(new)
    re_ = np.append(rs[1:], n)
    rc, joined = c[rs], ~edge[re_]  # joined: another run of the same text follows
    token = new.copy()
    last = re_ - 1
    ws = (rc == SPACE) & joined
    token[last[ws]] = True
    token[re_[ws & (cp[last] == 32)]] = False
    quote = (rc == OTHER) & joined & (re_ - rs == 1) & (cp[rs] == 39) & token[rs]
    for i in np.flatnonzero(quote & (np.append(rc[1:], OTHER) == LETTER)):
        s, e = rs[i] + 1, re_[i + 1]
        a, b = cp[s], cp[s + 1] if e - s > 1 else 0
        k = 1 if a in (115, 116, 109, 100) else 2 if (a, b) in ((114, 101), (118, 101), (108, 108)) else 0
        if k:
            token[s] = False
            if e - s > k:
                token[s + k] = True
    return np.flatnonzero(token)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    lengths = lengths.astype(np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - first, lengths)
