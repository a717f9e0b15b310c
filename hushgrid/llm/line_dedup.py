"""Line dedup by a segment-partition edit join.

Lines within ``EDITS`` edits share one of EDITS + 1 segments: a line is indexed under (its length, segment number, segment), and probes,
for every length up to EDITS below its own, the substrings where that segment can lie (multi-match-aware windows). Lines too short for
segments of CHARS_PER_EDIT characters meet in what is left when one character is deleted, of the line or of its first half. Candidates are
verified by a banded bit-parallel edit distance over the whole lines. Only 64-bit hashes are exchanged, once; line texts are read again
for candidates alone.

A line is a part of a text between line feeds, without blanks at its ends; an empty one is none. Equal lines of any length are linked by
their hash. Two lines are near if they differ in one edit for each CHARS_PER_EDIT characters of the shorter one, EDITS at most: below
that length only equal lines are linked, one edit being enough there to turn a word into another. Equal lines and verified pairs form
groups; the first line of a group, by doc_id and line number, stays, and a row is returned for every other line.

Defined cases: null and empty texts have no line, rows without doc_id are left alone; rows that repeat a doc_id have the same line
numbers, and their lines count once; texts and lines of any length are compared whole; of lines that are equally early (rows of one doc_id)
none is before the other, their place counts once; a pair with exactly the allowed edits is near; an empty table gives an empty result; other
columns, whatever their names, aren't read. Lines are identified by 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkern as tk
from .common import discard, materialise, small_side
from .graph import components
from .joins import two_sided_pairs

EDITS = 2
MIN_CHARS = 1
#: A pair of lines may differ in one edit for so many characters of the shorter one.
CHARS_PER_EDIT = 10
#: Sides of a posting: in the index, a probe of it, or both with one key.
INDEX, BOTH, PROBE = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15
_USUAL = 1 << 20
#: A line that occurs more often is compared where it occurs first only, so that a line of a third of all texts is no hot key.
REPEATS = 64
#: Lines that are looked up that way at most; where more occur so often, REPEATS rises.
MOST_REPEATED = 200_000
_BLANKS = "".join(map(chr, tk._WHITE))
#: Code points, padding included, of the pairs that are verified together.
VERIFIED = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64; kept for chunks of the usual size."""
    return _usual_powers() if n <= _USUAL else _new_powers(n)


@functools.cache
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _new_powers(_USUAL)


def _new_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def lines(t: tk.Text, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, line number, start and end of the lines that aren't empty, blanks at the ends cut off."""
    n = len(t.cp)
    feed = t.cp == 10
    begin = np.zeros(n + 1, bool)
    begin[t.at] = True
    begin[1:] |= feed
    s = np.flatnonzero(begin[:n])
    text = np.searchsorted(t.at, s, "right") - 1
    per = np.bincount(text, minlength=len(t.at) - 1)
    number = np.arange(len(s)) - np.repeat(np.cumsum(per) - per, per)
    solid = np.flatnonzero(tk.tables()["cls"][t.cp] != tk.SPACE)
    e = np.append(s[1:], n)
    a = np.searchsorted(solid, s)
    b = np.searchsorted(solid, e)
    some = b > a
    text, number, a, b = text[some], number[some], a[some], b[some]
    s, e = solid[a], solid[b - 1] + 1
    long = e - s >= min_chars
    return text[long], number[long], s[long], e[long]


def allowed(size: np.ndarray, edits: int) -> np.ndarray:
    """Edits that a pair may differ in, by the length of its shorter line."""
    return np.minimum(edits, size // CHARS_PER_EDIT)


def postings(cp: np.ndarray, s: np.ndarray, e: np.ndarray, ids: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, side and id of distinct lines."""
    pw, inv = _powers(len(cp) + 1)
    code = tk.tables()["code"][cp]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * pw[: len(cp)], dtype=np.uint64)])
    size, every = e - s, np.arange(len(s))
    keys, left, out = [np.empty(0, np.int64)], [np.empty(0, np.int8)], [np.empty(0, np.int64)]

    def post(side: int, rows: np.ndarray, h: np.ndarray, target: np.ndarray, i: int) -> None:
        keys.append(tk.splitmix(h ^ tk.splitmix(target.astype(np.uint64) * np.uint64(64) + np.uint64(i))).astype(np.int64))
        left.append(np.full(len(rows), side, np.int8))
        out.append(ids[rows])

    def add(side: int, rows: np.ndarray, start: np.ndarray, length: np.ndarray, target: np.ndarray, i: int) -> None:
        post(side, rows, (total[start + length] - total[start]) * inv[start], target, i)

    def add_shortened(side: int, rows: np.ndarray, length: np.ndarray, target: np.ndarray, i: int) -> None:
        """The first ``length`` characters of the lines, with each one deleted in turn."""
        of = np.repeat(np.arange(len(rows)), length)
        start = s[rows][of]
        gap = start + np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
        h = (total[gap] - total[start]) * inv[start] + (total[start + length[of]] - total[gap + 1]) * inv[start + 1]
        post(side, rows[of], h, target[of], i)

    def segments(k: int, d: int, rows: np.ndarray, goal: np.ndarray) -> None:
        """One of k segments is equal."""
        base, longer = goal // k, goal % k
        for i in range(k):  # the last ``longer`` segments have one character more
            length = base + (i >= k - longer)
            p = base * i + np.maximum(0, i - (k - longer))
            low, high = max(-i, d - (k - 1 - i)), min(i, d + (k - 1 - i))
            for o in range(low, high + 1):
                fit = (p + o >= 0) & (p + o + length <= size[rows])
                add(BOTH if d == o == 0 else PROBE, rows[fit], (s[rows] + p + o)[fit], length[fit], goal[fit], i)

    def one_edit(d: int, rows: np.ndarray, goal: np.ndarray) -> None:
        """A character of each is replaced, or the longer one has one more."""
        if d == 0:
            add(INDEX, rows, s[rows], goal, goal, 60)
            add_shortened(BOTH, rows, goal, goal, 61)
        else:
            add_shortened(PROBE, rows, size[rows], goal, 60)

    def two_edits(d: int, rows: np.ndarray, goal: np.ndarray) -> None:
        """The second half is equal, or the first has one edit at most."""
        half = goal // 2
        add(PROBE, rows, e[rows] - (goal - half), goal - half, goal, 62)
        add_shortened(PROBE, rows, half + 1, goal, 60)
        if d == 0:
            add(INDEX, rows, e[rows] - (goal - half), goal - half, goal, 62)
            add(INDEX, rows, s[rows], half, goal, 60)
            add_shortened(INDEX, rows, half, goal, 61)
            add(PROBE, rows, s[rows], half - 1, goal, 61)
        if d < 2:
            add_shortened(PROBE, rows, half, goal, 61)
        else:
            add(PROBE, rows, s[rows], half, goal, 60)

    for a in range(1, edits + 1):
        for d in range(a + 1):
            target = size - d  # length of the indexed line
            here = allowed(target, edits) == a
            whole = here & (target >= CHARS_PER_EDIT * (a + 1)) if a <= 2 else here
            short = every[here & ~whole]
            segments(a + 1, d, every[whole], target[whole])
            if len(short):
                (one_edit if a == 1 else two_edits)(d, short, target[short])
    return np.concatenate(keys), np.concatenate(left), np.concatenate(out)


def _points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.int32)


def _plain_distance(x: np.ndarray, y: np.ndarray) -> int:
    row = np.arange(len(y) + 1)
    for i, c in enumerate(x.tolist(), 1):
        last, row[0] = row.copy(), i
        for j in range(1, len(y) + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != y[j - 1]))
    return int(row[-1])


def alike(xs: list[bytes], ys: list[bytes], edits: int) -> np.ndarray:
    """False for pairs that can't be within so many edits: an edit changes four bytes of each line at most, so 8 in the counts of bytes by class."""
    n = len(xs)
    sizes = np.array([len(v) for v in xs] + [len(v) for v in ys], np.int64)
    data = np.frombuffer(b"".join(xs) + b"".join(ys), np.uint8)
    bags = np.bincount(np.repeat(np.arange(2 * n) * 32, sizes) + (data & 31), minlength=64 * n).reshape(2 * n, 32)
    wide = np.add.reduceat(data >= 128, np.minimum(np.cumsum(sizes) - sizes, len(data) - 1)) > 0 if len(data) else np.zeros(2 * n, bool)
    most = np.where(wide[:n] | wide[n:], 8, 2) * edits  # two in lines of ASCII alone
    return np.abs(bags[:n] - bags[n:]).sum(1) <= most


def edit_distances(xs: list[np.ndarray], ys: list[np.ndarray], edits: int) -> np.ndarray:
    """Edit distance of each pair of code point arrays, or edits + 1 where it is greater: bit vectors in a diagonal band
    (Hyyrö's form of Myers' algorithm), all pairs at a time. The band's last row first goes down the diagonal, then along
    the last row of the matrix. ``edits`` is below 31."""
    out = np.full(len(xs), edits + 1)
    la, lb = np.array([len(x) for x in xs], np.int64), np.array([len(y) for y in ys], np.int64)
    near = np.abs(la - lb) <= edits
    for i in np.flatnonzero(near & (la <= edits)):
        out[i] = min(edits + 1, _plain_distance(xs[i], ys[i]))
    todo = np.flatnonzero(near & (la > edits))
    if not len(todo):
        return out
    la, lb = la[todo], lb[todo]
    n, columns, w = len(todo), int(lb.max()), 2 * edits + 1
    A, B = np.full((n, columns + w), -1, np.int32), np.full((n, columns), -2, np.int32)
    for r, i in enumerate(todo):
        k = min(len(xs[i]), columns + edits)
        A[r, edits : edits + k] = xs[i][:k]  # shifted, so that column j of B meets A[:, j : j + w]
        B[r, : lb[r]] = ys[i]
    A, B = np.ascontiguousarray(A.T), np.ascontiguousarray(B.T)
    u = np.uint64
    vp, vn = np.full(n, (0xFFFFFFFFFFFFFFFF << (63 - edits)) & 0xFFFFFFFFFFFFFFFF, u), np.zeros(n, u)
    score, final = np.full(n, edits, np.int64), np.full(n, edits + 1, np.int64)
    for j in range(columns):
        m = np.zeros(n, u)
        for r in range(w):
            m |= (A[j + r] == B[j]).astype(u) << u(63 - (w - 1) + r)
        d0 = (((m & vp) + vp) ^ vp) | m | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        down = j < la - edits
        along = u(1) << np.where(down, 63, 62 - (j - (la - edits))).clip(0, 63).astype(u)
        score += np.where(down, (d0 & along) == 0, ((hp & along) != 0).astype(np.int64) - ((hn & along) != 0))
        d0 >>= u(1)
        vp, vn = hn | ~(d0 | hp), d0 & hp
        ended = lb == j + 1
        final[ended] = score[ended]
    out[todo] = np.minimum(final, edits + 1)
    return out


def own_ids(t: tk.Text, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The hash of each line, as ``placed`` computes it."""
    raw, byte, digest = t.data.tobytes(), t.byte, xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[p:q], 42) for p, q in zip(byte[s].tolist(), byte[e].tolist(), strict=True)), np.uint64, len(s)).astype(np.int64)


def placed(docs: DataFrame, *keep: str) -> DataFrame:
    """(id, words, line, …) of every line that isn't empty, without the blanks at its ends; the id is its hash. All in the JVM."""
    cut = docs.select(*keep, F.posexplode(F.split("text", "\n", -1)).alias("line", "raw")).withColumn("words", F.btrim("raw", F.lit(_BLANKS)))
    return cut.where("words <> ''").select(F.xxhash64("words").alias("id"), "words", F.col("line").cast("long").alias("line"), *keep)


def repeated(seen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines that occur more than REPEATS times: hash, ascending, with the first place (doc_id and line)."""
    most = max(REPEATS, seen.count() // MOST_REPEATED)
    got = seen.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("first")).where(F.col("n") > most)
    t = got.select("id", "first.doc_id", "first.line").orderBy("id").toArrow().combine_chunks()
    return t["id"].to_numpy(), t["doc_id"].to_numpy(), t["line"].to_numpy()


def _chunks(column: pa.Array) -> Iterator[tuple[int, tk.Text, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    data, off = tk.utf8(column)
    for a, b in tk.chunks(off):
        t = tk.Text(data[off[a] : off[b]], off[a : b + 1])
        found = lines(t)
        if len(found[0]):
            yield a, t, found


def dedup(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, line) of every line that repeats an earlier one up to the allowed edits (``edits`` at most), and the first line of its group (of_doc, of_line)."""
    spark = docs.sparkSession
    docs = docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def own_lines(batch: pa.RecordBatch) -> Iterator[tuple[tk.Text, np.ndarray, np.ndarray, np.ndarray]]:
        """The distinct lines of each chunk of (text, doc_id): hash, start and end. What is repeated often is there at its first place only."""
        ids, docs_, lines_ = often.value
        for a, t, (text, number, s, e) in _chunks(batch.column(0)):
            h = own_ids(t, s, e)
            if len(ids):
                at = np.minimum(np.searchsorted(ids, h), len(ids) - 1)
                doc = batch.column(1).to_numpy()[text + a]
                first = (ids[at] != h) | ((docs_[at] == doc) & (lines_[at] == number))
                h, s, e = h[first], s[first], e[first]
            h, at = np.unique(h, return_index=True)
            if len(h):
                yield t, h, s[at], e[at]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, h, s, e in own_lines(batch):
                key, left, ids = postings(t.cp, s, e, h, edits)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(left)], names=["key", "id", "left"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            size = np.array([max(len(v), len(w)) for v, w in zip(x, y, strict=True)], np.int64)
            order = np.argsort(size, kind="stable")
            keep, at = np.zeros(len(x), bool), 0
            while at < len(order):  # blocks of lines of about equal length, bounded with their padding
                fits = size[order[at:]] * np.arange(1, len(order) - at + 1) <= VERIFIED
                block = order[at : at + max(1, int(np.argmin(fits)) if not fits.all() else len(fits))]
                at += len(block)
                block = block[alike([x[i] for i in block], [y[i] for i in block], edits)]
                if not len(block):
                    continue
                px, py = [_points(x[i]) for i in block], [_points(y[i]) for i in block]
                shorter = np.array([min(len(p), len(q)) for p, q in zip(px, py, strict=True)])
                keep[block] = edit_distances(px, py, edits) <= allowed(shorter, edits)
            yield batch.select([0, 1]).filter(pa.array(keep))

    seen = materialise(placed(docs, "doc_id").select("id", "doc_id", "line"))
    often = spark.sparkContext.broadcast(repeated(seen))
    pairs = two_sided_pairs(docs.select("text", "doc_id").mapInArrow(post, "key long, id long, left byte"))
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = materialise(placed(docs).select("id", F.encode("words", "UTF-8").alias("words")).join(small_side(wanted), "id", "left_semi").groupBy("id").agg(F.min("words").alias("words")))
    side = lambda c: texts.select(F.col("id").alias(c), F.col("words").alias(f"words_{c}"))
    near = materialise(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "words_a", "words_b").mapInArrow(verify, "a long, b long"))
    discard(spark, [pairs, wanted, texts])
    group = small_side(components(near))
    discard(spark, [near])
    rooted = seen.join(group, F.col("id") == F.col("node"), "left").select(F.coalesce("root", "id").alias("root"), "doc_id", "line")
    first = materialise(rooted.groupBy("root").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first"))
    out = rooted.join(small_side(first), "root").select("doc_id", "line", F.col("first.doc_id").alias("of_doc"), F.col("first.line").alias("of_line"))
    return out.where("doc_id <> of_doc or line <> of_line").distinct()
