"""Quality classifier: factorisation machines over hashed words, structure statistics and metadata.

A score is ``b + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``: the sum-of-squares identity, linear in the
non-zero features. Two machines share one pass over the features: one for quality, to which a word counts by its share of the text, one
for toxicity, to which it counts as much in a long text as in a short one. Both are fitted by AdaGrad on a bounded sample of labelled rows,
over the features of which it gives evidence: those that occur in one class so much more than in the other that chance is ruled out
(likelihood ratio), however rare they or the class are. Features without evidence have no weight.

Defined cases: a null text counts as empty; an empty text has structure and metadata features only; null labels aren't trained
on; a doc_id with several labels is trained on each; without labelled rows probabilities are null and all rows are kept, and so for
one head whose labels are all alike; repeated rows are scored alike; a probability that equals a limit passes it; an empty table
gives an empty result; null metadata is a value of its own. Texts of any length are read whole. Of other columns, whatever their
names, nothing is read; filtering keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkern as tk
from .common import arrow_batches, fresh

WORDS = 1 << 20
META = 1 << 10
STEPS = 16
N_STATS = 12
DIM = WORDS + META + STEPS * N_STATS
RANK = 8
#: Bound of the training sample: about so many labelled rows, chosen by a hash of doc_id.
TRAIN_ROWS = 6000
#: Least likelihood ratio (G) of a feature and a label: at 12, one in 2,000 features without any relation would pass.
MIN_EVIDENCE = 12.0
MIN_QUALITY, MAX_TOXIC = 0.5, 0.5


def by_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weights=values, minlength=n)


def features(data: np.ndarray, off: np.ndarray, meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature, and values for quality and for toxicity of every non-zero feature, by text. ``meta``: a hash of each metadata column."""
    t = tk.Text(data, off)
    n, tab = len(t.at) - 1, tk.tables()
    h, text, ws, we = tk.words(t)
    size = np.maximum(1, np.diff(t.at)).astype(float)
    cls = tab["cls"][t.cp]
    of = np.repeat(np.arange(n), np.diff(t.at))
    counts = lambda mask: np.bincount(of[mask], minlength=n)
    letters, nw = np.maximum(1, counts(cls == tk.LETTER)), np.bincount(text, minlength=n)
    key = text * WORDS + (h & np.uint64(WORDS - 1)).astype(np.int64)
    u, c = np.unique(key, return_counts=True)
    ut, ub = u // WORDS, u % WORDS
    ls, le = tk.runs_of(t.cp != 10, t.at)
    lt = np.searchsorted(t.at, ls, "right") - 1
    lines = np.maximum(1, np.bincount(lt, minlength=n))
    lh = tk.segment_hash(tab["code"][t.cp], ls, le)
    order = np.lexsort((lh, lt))
    same = np.zeros(len(lh), bool)
    same[order[1:]] = (lh[order][1:] == lh[order][:-1]) & (lt[order][1:] == lt[order][:-1])
    tri = text[2:] == text[:-2] if len(h) > 2 else np.empty(0, bool)
    if tri.any():
        th = tk.splitmix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))[tri]
        tt = text[:-2][tri]
        o = np.lexsort((th, tt))
        rep = (th[o][1:] == th[o][:-1]) & (tt[o][1:] == tt[o][:-1])
        repeats = np.bincount(tt[o][1:][rep], minlength=n) / np.maximum(1, np.bincount(tt, minlength=n))
    else:
        repeats = np.zeros(n)
    words_ = np.maximum(1, nw)
    stats = [
        np.log2(1 + nw) / 15,
        counts(tab["upper"][t.cp]) / letters,
        counts(cls == tk.NUMBER) / size * 4,
        counts((cls == tk.OTHER)) / size * 2,
        counts((t.cp == 33) | (t.cp == 36) | (t.cp == 37) | (t.cp == 38) | (t.cp == 35) | (t.cp == 42)) / size * 6,
        counts(t.cp == 124) / size * 10,
        by_text((we - ws).astype(float), text, n) / words_ / 16,
        np.bincount(ut, minlength=n) / words_,
        by_text(same.astype(float), lt, n) / lines,
        repeats,
        np.minimum(1, np.log2(1 + size / lines) / 14),
        counts((t.cp == 46) | (t.cp == 44)) / words_ * 2,
    ]
    value = np.log1p(c)
    plain = 0.5 * np.minimum(value / np.log(2), 1.2)
    norm = np.sqrt(by_text(value * value, ut, n))
    value = value / np.maximum(1e-9, norm[ut]) * 2
    rows = [ut, *[np.arange(n)] * (N_STATS + len(meta))]
    index = [ub, *[WORDS + META + k * STEPS + np.clip((s * STEPS).astype(np.int64), 0, STEPS - 1) for k, s in enumerate(stats)], *[WORDS + (m % META) for m in meta]]
    rest = [*[np.full(n, 0.5)] * N_STATS, *[np.full(n, 0.25)] * len(meta)]
    r, i, v, p = np.concatenate(rows), np.concatenate(index), np.concatenate([value, *rest]), np.concatenate([plain, *rest])
    order = np.argsort(r, kind="stable")
    return r[order], i[order].astype(np.int64), v[order].astype(np.float32), p[order].astype(np.float32)


def meta_hash(column: pa.Array, salt: int) -> np.ndarray:
    """Hash of each value of a metadata column; null is a value of its own."""
    d = pc.dictionary_encode(pc.fill_null(column.cast(pa.string()), "\0"))
    data, off = tk.utf8(d.dictionary)
    t = tk.Text(data, off)
    keys = np.zeros(len(off) - 1, np.uint64)
    full = np.diff(t.at) > 0
    if full.any():
        keys[full] = tk.segment_hash(tk.tables()["code"][t.cp], t.at[:-1][full], t.at[1:][full])
    return (tk.splitmix(keys + np.uint64(salt)) >> np.uint64(20)).astype(np.int64)[np.asarray(d.indices)]


@dataclass
class Machine:
    b: float
    w: np.ndarray
    v: np.ndarray
    dense: np.ndarray | None = None  # the number of each feature, -1 for those without a weight; None: features are numbers

    def scores(self, r: np.ndarray, i: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """Linear time: sums of v x and of their squares by text."""
        if self.dense is not None:
            i = self.dense[i]
            r, i, x = r[i >= 0], i[i >= 0], x[i >= 0]
        out = self.b + np.bincount(r, weights=self.w[i] * x, minlength=n)
        if len(r):
            vx = self.v[i] * x[:, None]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            s, q = np.add.reduceat(vx, first), np.add.reduceat(vx * vx, first)
            out[r[first]] += 0.5 * (s * s - q).sum(1)
        return out


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], dim: int, epochs: int = 8, rate: float = 0.15, l2: float = 1e-5) -> Machine | None:
    """AdaGrad on the logistic loss, the rarer class weighted by the root of what would make sums equal; None if only one class is there."""
    ys = np.array([y for y, _, _ in rows])
    if not len(ys) or ys.min() == ys.max():
        return None
    weight = {1: (0.5 * len(ys) / ys.sum()) ** 0.5, 0: (0.5 * len(ys) / (len(ys) - ys.sum())) ** 0.5}
    rng = np.random.default_rng(11)
    w, v = np.zeros(dim, np.float32), (rng.standard_normal((dim, RANK)) * 0.02).astype(np.float32)
    gw, gv, b, gb = np.full(dim, 1e-2, np.float32), np.full((dim, RANK), 1e-2, np.float32), 0.0, 1e-2
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, i, x = rows[k]
            vi = v[i]
            s = x @ vi
            z = b + w[i] @ x + 0.5 * float((s * s).sum() - ((vi * x[:, None]) ** 2).sum())
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight[int(y)]
            gb += d * d
            b -= rate * d / np.sqrt(gb)
            g = d * x + l2 * w[i]
            gw[i] += g * g
            w[i] -= rate * g / np.sqrt(gw[i])
            g = d * (x[:, None] * s - vi * (x * x)[:, None]) + l2 * vi
            gv[i] += g * g
            v[i] = vi - 0.3 * rate * g / np.sqrt(gv[i])
    return Machine(float(b), w, v)


@dataclass
class Model:
    quality: Machine | None
    toxic: Machine | None


def evidence(row: np.ndarray, feature: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By feature, the likelihood ratio G of its occurrence and the labels y (0 or 1) of the rows; a row has a feature once at most."""
    n, ones = len(y), float(y.sum())
    k1, k = (np.bincount(f, minlength=DIM).astype(float) for f in (feature[y[row] == 1], feature))
    g = np.zeros(DIM)
    for seen, of, share in ((k1, ones, k / n), (k - k1, n - ones, k / n), (ones - k1, ones, 1 - k / n), (n - ones - k + k1, n - ones, 1 - k / n)):
        some = seen > 0
        g[some] += 2 * seen[some] * np.log(seen[some] / (of * share[some]))
    return g


def fit_head(rows: list[tuple[int, np.ndarray, np.ndarray]], least: float = MIN_EVIDENCE) -> Machine | None:
    """A machine over the features with evidence, from (label, features, values) of rows."""
    y = np.array([r[0] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return None
    g = evidence(np.repeat(np.arange(len(y)), [len(i) for _, i, _ in rows]), np.concatenate([i for _, i, _ in rows]), y)
    dense = np.where(g >= least, np.cumsum(g >= least) - 1, -1).astype(np.int32)

    def known(i: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = dense[i]
        return k[k >= 0], x[k >= 0]

    m = fit([(label, *known(i, x)) for label, i, x in rows], int((g >= least).sum()))
    if m:
        m.dense = dense
    return m


def metadata(batch: pa.RecordBatch, at: list[int]) -> list[np.ndarray]:
    return [meta_hash(batch.column(k), n) for n, k in enumerate(at)]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Both machines from labels (doc_id, quality, toxic) joined with their texts. The sample has about ``rows`` rows."""
    labelled = labels.where(F.col("doc_id").isNotNull()).select(labels["doc_id"].cast("long"), labels["quality"].cast("int"), labels["toxic"].cast("int"))
    n = labelled.count()
    if not n:
        return Model(None, None)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / n)))
    data = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"), docs["lang"].cast("string"), docs["source"].cast("string")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tk.utf8(batch.column(1))
            meta = metadata(batch, [2, 3])
            for a, b in tk.chunks(off):
                r, i, x, plain = features(data[off[a] : off[b]], off[a : b + 1], [m[a:b] for m in meta])
                to = np.searchsorted(r, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in (0, 4, 5)), pa.array([i[p:q].astype(np.int32).tobytes() for p, q in zip(to[:-1], to[1:], strict=True)]), *(pa.array([v[p:q].tobytes() for p, q in zip(to[:-1], to[1:], strict=True)]) for v in (x, plain))],
                    names=["doc_id", "quality", "toxic", "i", "x", "plain"],
                )

    got = sorted(data.mapInArrow(run, "doc_id long, quality int, toxic int, i binary, x binary, plain binary").collect(), key=lambda r: (r[0], str(r[1]), str(r[2]), len(r[3])))
    head = lambda label, value: fit_head([(int(r[label] > 0), np.frombuffer(r[3], np.int32), np.frombuffer(r[value], np.float32)) for r in got if r[label] is not None])
    return Model(head(1, 4), head(2, 5))


def score(model: Model, text: pa.Array, meta: list[np.ndarray]) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Probabilities of quality and of toxicity; None for a machine that isn't there."""
    data, off = tk.utf8(text)
    out = [np.zeros(len(off) - 1) if m else None for m in (model.quality, model.toxic)]
    for a, b in tk.chunks(off):
        r, i, *values = features(data[off[a] : off[b]], off[a : b + 1], [m[a:b] for m in meta])
        for o, m, x in zip(out, (model.quality, model.toxic), values, strict=True):
            if m:
                o[a:b] = 1 / (1 + np.exp(-np.clip(m.scores(r, i, x, b - a), -30, 30)))
    return out[0], out[1]


def kept(quality: np.ndarray | None, toxic: np.ndarray | None, n: int, min_quality: float, max_toxic: float) -> np.ndarray:
    out = np.ones(n, bool)
    if quality is not None:
        out &= quality >= min_quality
    if toxic is not None:
        out &= toxic <= max_toxic
    return out


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, min_quality: float = MIN_QUALITY, max_toxic: float = MAX_TOXIC) -> DataFrame:
    """doc_id, both probabilities, kept or not; a row for each row, one narrow pass after training."""
    arrow_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            q, t = score(model.value, batch.column(1), metadata(batch, [2, 3]))
            probs = [pa.nulls(n, pa.float64()) if p is None else pa.array(p) for p in (q, t)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *probs, pa.array(kept(q, t, n, min_quality, max_toxic))], names=["doc_id", "quality", "toxic", "kept"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"), docs["lang"].cast("string"), docs["source"].cast("string")).mapInArrow(run, "doc_id long, quality double, toxic double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, min_quality: float = MIN_QUALITY, max_toxic: float = MAX_TOXIC) -> DataFrame:
    """The rows that both machines let pass, all their columns unchanged."""
    arrow_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))
    extra = [fresh(docs.columns, f"{c}_to_score") for c in ("text", "lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 3
            q, t = score(model.value, batch.column(k), metadata(batch, [k + 1, k + 2]))
            yield batch.filter(pa.array(kept(q, t, batch.num_rows, min_quality, max_toxic))).select(list(range(k)))

    return docs.select("*", *[docs[c].cast("string").alias(x) for c, x in zip(("text", "lang", "source"), extra, strict=True)]).mapInArrow(run, docs.schema)
