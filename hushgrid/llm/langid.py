"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are trained with follow-the-regularised-leader (per-coordinate rates, elastic net) on a bounded sample of labelled
rows, then one temperature is fitted on held-out rows (every fifth of a language; 1 if there is none). Document frequencies are counted over all documents.

Defined cases: a text that is null, empty or without a letter has no n-gram, so language and probability are null and the row is
rejected; a null label isn't trained on; with no labelled row at all, languages are null and rows with letters are accepted;
repeated rows are scored alike; ties go to the alphabetically first language; texts of any length are read whole; an empty
table gives an empty result. Of other columns, whatever their names, nothing is read; filtering keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkern as tk
from .common import arrow_batches, fresh

BINS = 1 << 16
ORDERS = (1, 2, 3)
#: Bound of the training sample: about so many labelled rows a language, chosen by a hash of doc_id.
TRAIN_PER_CLASS = 1500
MIN_CONFIDENCE = 0.5
SMOOTHING = 0.02


def ngrams(t: tk.Text) -> list[np.ndarray]:
    """Hashed n-grams of each text. Letters are lower-cased, each run of other characters is one blank."""
    tab = tk.tables()
    letter = tab["cls"][t.cp] == tk.LETTER
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others
    if len(keep):
        start = t.at[:-1][t.at[:-1] < len(keep)]
        keep[start] = letter[start]
    total = np.concatenate([[0], np.cumsum(keep)])
    at = total[t.at]
    code = np.where(letter, tab["lower"][t.cp], 32)[keep]
    code = tab["code"][code]
    n = len(code)
    out: list[list[np.ndarray]] = [[] for _ in range(len(at) - 1)]
    if not n:
        return [np.empty(0, np.int64) for _ in out]
    h = np.zeros(n, np.uint64)
    every = []
    for k in range(max(ORDERS)):
        h = h[: n - k] * np.uint64(0xD6E8FEB86659FD93) + code[k:]
        if k + 1 in ORDERS:
            x = h + np.uint64(k)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            every.append(((x >> np.uint64(48)).astype(np.int64), k))
        if n - k - 1 <= 0:
            break
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        out[i] = [x[a : max(a, b - k)] for x, k in every]
    return [np.concatenate(x) for x in out]


def term_counts(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = np.bincount(bins, minlength=BINS)
    i = np.flatnonzero(c)
    return i, c[i]


def texts(column: pa.Array) -> Iterator[tuple[int, tk.Text]]:
    data, off = tk.utf8(column)
    for a, b in tk.chunks(off):
        yield a, tk.Text(data[off[a] : off[b]], off[a : b + 1])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bin, and documents with any, over the whole table. Each task sends one row a bin at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BINS + 1, np.int64), 0
        for batch in batches:
            for _, t in texts(batch.column(0)):
                for bins in ngrams(t):
                    if len(bins):
                        df[:BINS] += np.bincount(bins, minlength=BINS) > 0
                        n += 1
        df[BINS] = n
        i = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(df[i])], names=["bin", "n"])

    rows = docs.select(docs["text"].cast("string")).mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BINS + 1, np.int64)
    df[rows["bin"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return df[:BINS], int(df[BINS])


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # bins x classes
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        x = (1 + np.log(c)) * self.idf[i]
        return (x / max(1e-12, np.sqrt((x * x).sum()))).astype(np.float32)

    def logits(self, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.vector(i, c) @ self.weights[i] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], model: Model, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> None:
    """FTRL-proximal; rows are (class, bins, counts). l1 and l2 are the elastic net."""
    k = len(model.classes)
    z, n = np.zeros((BINS + 1, k), np.float32), np.zeros((BINS + 1, k), np.float32)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((beta + np.sqrt(ni)) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            y, i, c = rows[r]
            x = np.append(model.vector(i, c), np.float32(1))
            i = np.append(i, BINS)  # the bias
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] = zi + g - s * w
            n[i] = ni + g * g
    w = weights(z, n)
    model.weights, model.bias = w[:BINS], w[BINS]


def fit_temperature(rows: list[tuple[int, np.ndarray, np.ndarray]], model: Model) -> None:
    """The temperature of least cross-entropy on held-out rows, by golden-section search. Targets are smoothed by ``SMOOTHING``:
    where the held-out rows are separated perfectly, a bare likelihood would send the temperature to 0."""
    if not rows:
        return
    z, y = np.array([model.logits(i, c) for _, i, c in rows]), np.array([r[0] for r in rows])

    def loss(log_t: float) -> float:
        logs = np.log(softmax(z / np.exp(log_t)) + 1e-12)
        return float(-((1 - SMOOTHING) * logs[np.arange(len(y)), y] + SMOOTHING * logs.mean(1)).mean())

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    model.temperature = float(np.exp((a + b) / 2))


def train(docs: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Model | None:
    """A model from the rows with a label in ``lang``; None if there are none. Every fifth row of a language is held out for the temperature."""
    sizes = {r[0]: r[1] for r in docs.where(F.col("lang").isNotNull()).groupBy("lang").count().collect()}
    if not sizes:
        return None
    classes = sorted(sizes)
    df, n = document_frequencies(docs)
    share = F.create_map(*[x for k in classes for x in (F.lit(k), F.lit(min(1.0, per_class / sizes[k])))])
    sample = docs.where(F.col("lang").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)).select("doc_id", "lang", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, t in texts(batch.column(2)):
                got = [term_counts(x) for x in ngrams(t)]
                k = len(got)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, k), batch.column(1).slice(a, k), pa.array([i.astype(np.uint16).tobytes() for i, _ in got]), pa.array([c.astype(np.int32).tobytes() for _, c in got])],
                    names=["doc_id", "lang", "bins", "counts"],
                )

    rows = sample.mapInArrow(run, "doc_id long, lang string, bins binary, counts binary").collect()
    rows = sorted(((r[0] if r[0] is not None else -1, classes.index(r[1]), np.frombuffer(r[2], np.uint16).astype(np.int64), np.frombuffer(r[3], np.int32)) for r in rows if r[2]), key=lambda r: (r[0], r[1], len(r[2])))
    model = Model(classes, np.zeros((BINS, len(classes)), np.float32), np.zeros(len(classes), np.float32), np.log((1 + n) / (1 + df)) + 1)
    seen, held = [0] * len(classes), []
    for _, k, *_ in rows:
        seen[k] += 1
        held.append(seen[k] % 5 == 0)
    fit_ftrl([r[1:] for r, h in zip(rows, held, strict=True) if not h], model)
    fit_temperature([r[1:] for r, h in zip(rows, held, strict=True) if h], model)
    return model


def predict(model: Model | None, column: pa.Array) -> tuple[list[str | None], list[float | None], np.ndarray]:
    """Language, calibrated probability and number of n-grams of each text."""
    lang: list[str | None] = []
    prob: list[float | None] = []
    grams: list[int] = []
    for _, t in texts(column):
        for bins in ngrams(t):
            grams.append(len(bins))
            if model is None or not len(bins):
                lang.append(None)
                prob.append(None)
                continue
            p = softmax(model.logits(*term_counts(bins)) / model.temperature)
            k = int(p.argmax())
            lang.append(model.classes[k])
            prob.append(float(p[k]))
    return lang, prob, np.array(grams, np.int64)


def accepted(lang: list[str | None], prob: list[float | None], grams: np.ndarray, min_confidence: float) -> np.ndarray:
    return np.array([n > 0 and (p is None or p >= min_confidence) for p, n in zip(prob, grams, strict=True)], bool)


def identify(docs: DataFrame, per_class: int = TRAIN_PER_CLASS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """doc_id, declared label, predicted language, calibrated probability, accepted or not; a row for each row."""
    arrow_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, prob, grams = predict(model.value, batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(prob, pa.float64()), pa.array(accepted(lang, prob, grams, min_confidence), pa.bool_())], names=["doc_id", "lang", "predicted", "probability", "accepted"]
            )

    return docs.select(docs["doc_id"].cast("long"), docs["lang"].cast("string"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, lang string, predicted string, probability double, accepted boolean")


def keep_accepted(docs: DataFrame, per_class: int = TRAIN_PER_CLASS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The rows with an accepted language, all their columns unchanged; one narrow pass after training."""
    arrow_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, per_class))
    at = fresh(docs.columns, "text_to_identify")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = accepted(*predict(model.value, batch.column(batch.num_columns - 1)), min_confidence)
            yield batch.filter(pa.array(mask)).select(list(range(batch.num_columns - 1)))

    return docs.withColumn(at, F.col("text").cast("string")).mapInArrow(run, docs.schema)
