"""Packing, tokens, classifiers and extraction against brute force, held-out labels and round trips."""

from __future__ import annotations

import base64

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hushgrid.llm import bpe, html_crf, langid, packing, prefix_counts, quality_fm
from hushgrid.llm import textkern as tk
from hushgrid.llm.common import table

from conftest import TINY

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "a", "  \n\n  x ", "I'll we've they're 'tis '", "été 🙂🙂 ñandú́", "x" * 300, "ab " * 70_000, "1234567890" * 40, "\t\t a\r\n\r\n  b", "it's  'll", "same", "same"]


def odd(spark):
    rows = [(i, t, "en", None, None) for i, t in enumerate(ODD)] + [(None, "no id", None, "s", 5), (11, "same", "en", None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers as p

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_vocabulary(), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def text_of(s):
    raw = np.frombuffer(s.encode(), np.uint8)
    return tk.Text(raw, np.array([0, len(raw)]))


@given(st.text(st.sampled_from("ab 'lsterv\n\t1é🙂.,"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_a_reference_encoder_and_prefixes_are_exact(encoding, s):
    raw = bpe.read_vocabulary()
    ids, _ = bpe.encoder(raw).encode(text_of(s))
    assert ids.tolist() == encoding.encode_ordinary(s)
    got = prefix_counts.counter(raw).counts(text_of(s)).tolist()
    assert got == [len(encoding.encode_ordinary(s[: k + 1])) for k in range(len(s))]


def test_bpe_over_odd_rows(spark, encoding):
    docs = odd(spark)
    rows = bpe.encode(docs).collect()
    assert len(rows) == docs.count()
    want = {(r.doc_id, r.text): r.text for r in docs.collect()}
    back = sorted((str(r.doc_id), str(r.text)) for r in bpe.decode(bpe.encode(docs)).collect())
    assert back == sorted((str(i), str(t)) for i, t in ((r.doc_id, r.text) for r in docs.collect())) and want
    for r in rows:
        if r.doc_id is not None and r.doc_id < len(ODD):
            t = ODD[r.doc_id]
            assert r.ids == (None if t is None else encoding.encode_ordinary(t)) or r.doc_id == 11
            assert t is None or r.round_trip
    assert bpe.encode(docs.limit(0)).count() == 0


def test_words_beyond_the_power_table_are_told_apart(encoding):
    """Swapped halves of words of more than 65,536 characters once had equal hashes, and so the ids of one another."""
    raw = bpe.read_vocabulary()
    enc, count = bpe.Encoder(raw), prefix_counts.Counter(raw)
    for s in ("a" * 65536 + "b" * 65536, "b" * 65536 + "a" * 65536):
        ids, _ = enc.encode(text_of(s))
        assert b"".join(enc.v.tokens[i] for i in ids) == s.encode() and ids.tolist() == encoding.encode_ordinary(s)
        assert count.counts(text_of(s))[-1] == len(ids)
    t = text_of("".join(c * 65536 for c in "abba"))
    h, h2 = tk.segment_hash(tk.tables()["code"][t.cp], np.array([0, 131072]), np.array([131072, 262144]), check=True)
    assert h[0] != h[1] and h2[0] != h2[1]


def test_tokens_of_any_length_are_counted(encoding):
    """A vocabulary with a token of 2,048 bytes, made of merges by halves."""
    ranks = {bytes([i]): i for i in range(256)} | {b"a" * (1 << k): 255 + k for k in range(1, 12)}
    raw = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items())
    own = tiktoken.Encoding("long", pat_str=encoding._pat_str, mergeable_ranks=ranks, special_tokens={})
    s = "a" * 5000
    got = prefix_counts.Counter(raw).counts(text_of(s)).tolist()
    for k in (1, 2, 3, 1023, 1024, 1025, 2047, 2048, 2049, 4095, 4096, 4999, 5000):
        assert got[k - 1] == len(own.encode_ordinary(s[:k]))
    assert bpe.Encoder(raw).encode(text_of(s))[0].tolist() == own.encode_ordinary(s)


def test_long_pieces_use_a_tree_of_their_own(encoding):
    v = bpe.vocabulary(bpe.read_vocabulary())
    for s in ("x" * 1000, "abcdefghij" * 90):
        assert bpe.merge_long(v, s.encode()) == encoding.encode_ordinary(s)


def test_prefix_counts_answer_budgets(spark, encoding):
    docs = odd(spark)
    counted = prefix_counts.count(docs)
    rows = {r.doc_id: r for r in counted.select("*", prefix_counts.tokens_at(3).alias("at"), prefix_counts.chars_within(2).alias("within")).where("doc_id < 11").collect()}
    assert (rows[1].n_tokens, rows[1].at, rows[1].within) == (None, None, None) and rows[0].n_tokens == 0
    for i in (2, 3, 4, 5, 8, 9, 10):
        t = ODD[i]
        n = [len(encoding.encode_ordinary(t[: k + 1])) for k in range(len(t))]
        assert rows[i].n_tokens == n[-1] and rows[i].at == n[min(3, len(t)) - 1]
        assert rows[i].within == max((k + 1 for k in range(len(t)) if n[k] <= 2), default=0)
    whole = rows[7]
    assert whole.n_chars == len(ODD[7]) and len(encoding.encode_ordinary(ODD[7][: whole.chars_512])) <= 512 < len(encoding.encode_ordinary(ODD[7][: whole.chars_512 + 3]))


def brute_pack(sizes, capacity):
    """The definition: of all places, the one with the least sum of squares; ties to the fullest bin, then the oldest by gap."""
    bins, out = [], []
    for s in sizes:
        best = None
        for g in sorted({capacity} | {x for x in bins if x}):
            if g < s:
                continue
            left = [x for x in bins if x]
            if g < capacity:
                left.remove(g)
            if g - s:
                left.append(g - s)
            score = sum(left.count(x) ** 2 for x in set(left))
            if best is None or score < best[0]:
                best = (score, g)
        g = best[1]
        if g == capacity:
            bins.append(capacity - s)
        else:
            bins[bins.index(g)] = g - s
        out.append(g)
    return out


@given(st.lists(st.integers(1, 12), max_size=60))
@settings(max_examples=200, deadline=None)
def test_packing_takes_the_least_sum_of_squares(sizes):
    where, offset = packing.sum_of_squares(np.array(sizes, np.int64), 12)
    assert (12 - offset).tolist() == brute_pack(sizes, 12)
    for b in set(where.tolist()):
        used = sorted((o, s) for w, o, s in zip(where, offset, sizes, strict=True) if w == b)
        assert sum(s for _, s in used) <= 12 and all(a[0] + a[1] == c[0] for a, c in zip(used, used[1:], strict=False))


def check_bins(rows, capacity):
    """Bins hold what they may, without a gap, slot after slot; pieces of a document are there once each."""
    bins = {}
    for r in rows:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for got in bins.values():
        got.sort(key=lambda r: r.offset)
        assert [r.slot for r in got] == list(range(len(got))) and got[0].offset == 0
        assert all(a.offset + a.n_tokens + 1 == b.offset for a, b in zip(got, got[1:], strict=False)) and got[-1].offset + got[-1].n_tokens + 1 <= capacity
    return bins


def test_packing_equals_brute_force_over_the_table(spark, encoding):
    """The whole query: documents in doc_id order, cut at the room of a bin, each placed by the definition."""
    docs = table(spark, TINY, "documents")
    rows = sorted(packing.pack(docs, capacity=512).collect(), key=lambda r: (r.doc_id, r.piece))
    sizes, want = [], []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        n = len(encoding.encode_ordinary(r.text))
        for k, a in enumerate(range(0, n, 511)):
            sizes.append(min(511, n - a) + 1)
            want.append((r.doc_id, k, a, sizes[-1] - 1))
    assert [(r.doc_id, r.piece, r.start, r.n_tokens) for r in rows] == want
    assert [512 - r.offset for r in rows] == brute_pack(sizes, 512)
    check_bins(rows, 512)


def test_open_bins_are_packed_over_shards(spark):
    import random

    rng = random.Random(1)
    docs = spark.createDataFrame([(i if i % 10 else None, "word " * rng.randrange(1, 40), None, "s", 1) for i in range(600)] + [(None, "same same", "x", None, 2)] * 2500, DOCS)
    one = packing.pack(docs, capacity=64).collect()
    several = packing.pack(docs, capacity=64, shard_rows=60)
    assert several.columns == packing.pack(docs).columns
    got = several.collect()
    assert len({r.shard for r in got}) > 40 and sorted(str((r.doc_id, r.piece, r.n_tokens)) for r in got) == sorted(str((r.doc_id, r.piece, r.n_tokens)) for r in one)
    bins = check_bins(got, 64)
    assert any(sum(r.n_tokens + 1 for r in x) < 64 for x in bins.values()) and len(bins) <= 1.05 * len(check_bins(one, 64)) + 20


def test_packing_keeps_every_token(spark, encoding):
    docs = odd(spark).withColumnRenamed("n_chars", "bin")
    rows = packing.pack(docs, capacity=64).collect()
    want = sum(len(encoding.encode_ordinary(r.text)) for r in docs.collect() if r.text)
    assert sum(r.n_tokens for r in rows) == want
    room = {}
    for r in rows:
        room[(r.shard, r.bin)] = room.get((r.shard, r.bin), 0) + r.n_tokens + 1
    assert max(room.values()) <= 64
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, capacity=1)


def test_languages_are_told_apart_on_held_out_rows(spark):
    docs = table(spark, TINY.replace("0.001", "0.01"), "documents")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    hidden = [r for r in docs.where("doc_id % 2 = 1 and length(text) > 40").select("text", "lang").collect()]
    import pyarrow as pa

    said, prob, _ = langid.predict(model, pa.array([r.text for r in hidden]))
    right = np.array([a == r.lang for a, r in zip(said, hidden, strict=True)])
    assert right.mean() > 0.95
    assert abs(np.mean(prob) - right.mean()) < 0.15  # calibrated
    assert (model.weights == 0).mean() > 0.5  # sparse


def test_languages_over_odd_rows(spark):
    docs = odd(spark).unionByName(spark.createDataFrame([(100 + i, t, g, None, None) for i in range(20) for t, g in (("the house and the garden", "en"), ("el perro y la casa grande", "es"))], DOCS))
    rows = {(r.doc_id): r for r in langid.identify(docs).collect()}
    assert rows[0].predicted is None and not rows[0].accepted and rows[1].predicted is None and rows[100].predicted in ("en", "es")
    kept = langid.keep_accepted(docs)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").count() == 0
    none = docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    assert langid.keep_accepted(none).where("text = 'same'").count() == 3
    assert langid.identify(docs.limit(0)).count() == 0


def test_factorisation_machine_uses_the_identity():
    rng = np.random.default_rng(1)
    m = quality_fm.Machine(0.3, rng.standard_normal(10), rng.standard_normal((10, 3)))
    i, x = np.array([1, 4, 7]), np.array([0.5, 2.0, -1.0])
    pairs = sum((m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(3) for b in range(a + 1, 3))
    assert np.isclose(m.scores(np.zeros(3, int), i, x, 1)[0], 0.3 + m.w[i] @ x + pairs)


def test_evidence_equals_the_likelihood_ratio():
    rng = np.random.default_rng(2)
    y, x = rng.integers(0, 2, 50), rng.random((50, 6)) < np.array([0.1, 0.5, 0.9, 0.02, 0.3, 1.0])
    row, feature = np.nonzero(x)
    got = quality_fm.evidence(row, feature, y)
    for k in range(6):
        want = sum(2 * n * np.log(n / (np.mean(x[:, k] == a) * np.mean(y == b) * 50)) for a in (False, True) for b in (0, 1) if (n := ((x[:, k] == a) & (y == b)).sum()))
        assert np.isclose(got[k], want, atol=1e-9)
    assert not got[6:].any()


def test_quality_query_equals_plain_scores(spark):
    """The whole query: every document scored pair by pair, from the words of its text counted one by one."""
    docs, labels = table(spark, TINY, "documents"), table(spark, TINY, "labels")
    model = quality_fm.train(docs, labels)
    import pyarrow as pa

    got = {r.doc_id: r for r in quality_fm.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.kept == (r.quality >= 0.5 and (r.toxic is None or r.toxic <= 0.5)) for r in got.values())
    for r in docs.limit(60).collect():
        data, off = tk.utf8(pa.array([r.text]))
        row, i, *values = quality_fm.features(data, off, [quality_fm.meta_hash(pa.array([c]), n) for n, c in enumerate((r.lang, r.source))])
        for m, x, p in zip((model.quality, model.toxic), values, (got[r.doc_id].quality, got[r.doc_id].toxic), strict=True):
            if m is None:
                assert p is None
                continue
            k = m.dense[i]
            some = [(int(a), float(b)) for a, b in zip(k, x, strict=True) if a >= 0]
            z = m.b + sum(m.w[a] * b for a, b in some) + sum(float(m.v[a] @ m.v[c]) * b * d for n, (a, b) in enumerate(some) for c, d in some[n + 1 :])
            assert np.isclose(p, 1 / (1 + np.exp(-z)), atol=1e-4)


def plain_ftrl(rows, classes, dim, epochs=3, alpha=0.5, beta=1.0, l1=0.02, l2=0.5):
    """The published per-coordinate update, one coordinate at a time."""
    z, n = {}, {}

    def weight(i, k):
        a = z.get((i, k), 0.0)
        return 0.0 if abs(a) <= l1 else -(a - np.sign(a) * l1) / ((beta + np.sqrt(n.get((i, k), 0.0))) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            y, x = rows[r]
            w = {(i, k): weight(i, k) for i in x for k in range(classes)}
            s = [sum(v * w[i, k] for i, v in x.items()) for k in range(classes)]
            p = np.exp(s - np.max(s)) / np.exp(s - np.max(s)).sum()
            for (i, k), wi in w.items():
                g = (p[k] - (k == y)) * x[i]
                old = n.get((i, k), 0.0)
                z[i, k] = z.get((i, k), 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * wi
                n[i, k] = old + g * g
    return np.array([[weight(i, k) for k in range(classes)] for i in range(dim)])


def test_ftrl_equals_a_plain_reimplementation():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(40):
        i = np.sort(rng.choice(12, 5, replace=False))
        rows.append((int(rng.integers(0, 3)), i, rng.integers(1, 4, 5)))
    model = langid.Model(["a", "b", "c"], np.zeros((langid.BINS, 3)), np.zeros(3), np.linspace(1, 2, langid.BINS))
    plain = [(y, dict(zip(i.tolist(), model.vector(i, c).astype(float).tolist(), strict=True)) | {12: 1.0}) for y, i, c in rows]
    langid.fit_ftrl(rows, model)
    want = plain_ftrl(plain, 3, 13)
    assert np.allclose(model.weights[:12], want[:12], atol=1e-4) and np.allclose(model.bias, want[12], atol=1e-4) and (want == 0).any()


def test_language_query_equals_plain_scores(spark):
    """The whole query against n-grams counted in Python; every row has its row."""
    docs = table(spark, TINY, "documents")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    df, n = langid.document_frequencies(docs)
    assert n == sum(any(c.isalpha() for c in r.text or "") for r in rows)
    for r in rows:
        bins = langid.ngrams(text_of(r.text))[0] if r.text else np.empty(0, np.int64)
        if not len(bins):
            assert got[r.doc_id].predicted is None
            continue
        i, c = np.unique(bins, return_counts=True)
        x = (1 + np.log(c)) * (np.log((1 + n) / (1 + df[i])) + 1)
        z = (x / np.linalg.norm(x)) @ model.weights[i] + model.bias
        p = np.exp(z / model.temperature - np.max(z / model.temperature))
        p /= p.sum()
        assert np.isclose(got[r.doc_id].probability, p.max(), atol=1e-3) and (got[r.doc_id].predicted == model.classes[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-3)
        assert got[r.doc_id].accepted == (got[r.doc_id].probability >= langid.MIN_CONFIDENCE)


def test_quality_on_held_out_rows(spark):
    """A third of the labelled rows, never trained on."""
    sf = TINY.replace("0.001", "0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = quality_fm.classify(docs, labels.where("doc_id % 3 <> 0")).join(labels.withColumnsRenamed({"quality": "q", "toxic": "t"}), "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    held = [r for r in got if r.doc_id % 3 == 0]
    toxic = [r for r in held if r.t == 1]
    clean = [r for r in held if r.q == 1 and r.t == 0]
    assert np.mean([(r.quality >= 0.5) == (r.q == 1) for r in held]) > 0.98
    assert len(toxic) > 100 and np.mean([r.toxic > 0.5 for r in toxic]) > 0.75
    assert np.mean([r.kept for r in clean]) > 0.99


def test_quality_over_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, None), (2, 1, 0), (None, 1, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality_fm.classify(docs, labels).count() == docs.count()
    unlabelled = quality_fm.classify(docs, labels.limit(0)).collect()
    assert all(r.quality is None and r.kept for r in unlabelled)
    kept = quality_fm.keep_good(docs.withColumnRenamed("n_chars", "text_to_score"), labels.limit(0))
    assert kept.count() == docs.count() and "text_to_score" in kept.columns
    assert quality_fm.classify(docs.limit(0), labels).count() == 0


def brute_labels(scores, moves, start):
    import itertools

    best = None
    for y in itertools.product((0, 1), repeat=len(scores)):
        v = start[y[0]] + sum(s for s, k in zip(scores, y, strict=True) if k) + sum(moves[a][b] for a, b in zip(y, y[1:], strict=False))
        if best is None or v > best[0] + 1e-12:
            best = (v, list(y))
    return best


@given(st.lists(st.floats(-3, 3), min_size=1, max_size=8), st.lists(st.floats(-2, 2), min_size=6, max_size=6))
@settings(max_examples=200, deadline=None)
def test_viterbi_finds_the_best_labels(scores, w):
    moves, start = [w[:2], w[2:4]], w[4:]
    y = html_crf.viterbi(scores, moves, start)
    v = start[y[0]] + sum(s for s, k in zip(scores, y, strict=True) if k) + sum(moves[a][b] for a, b in zip(y, y[1:], strict=False))
    assert abs(v - brute_labels(scores, moves, start)[0]) < 1e-9


def test_extraction(spark):
    sf = TINY.replace("0.001", "0.01")
    pages, docs = table(spark, sf, "pages"), table(spark, sf, "documents")
    model = html_crf.train(pages.where("page_id % 2 = 0"), docs)
    right = total = 0
    for r in html_crf.labelled_pages(pages.where("page_id % 2 = 1"), docs, 1_000_000).collect():
        found = html_crf.blocks(r.html)
        y = html_crf.label(found, r.document)
        if y:
            got = html_crf.viterbi(model.scores(found), model.moves.tolist(), model.start.tolist())
            right, total = right + sum(a == b for a, b in zip(got, y, strict=True)), total + len(y)
    assert total > 500 and right / total > 0.95


def test_blocks_of_long_deep_and_odd_pages():
    texts = lambda page: [b.text for b in html_crf.blocks(page)]
    page = "İ" * 30 + "<script>1</SCRIPT><p>kept text</p><p>more and more</p>"
    for pad in ("", "x" * 70_000):
        assert texts(page + pad)[1:3] == ["kept text", "more and more" ]
    deep = "<main>" + "<ul>" * 3000 + "x" + "</ul>" * 3000 + "y</main>z"
    x, y, z = html_crf.blocks(deep)
    assert html_crf._id("any main") in html_crf.path_features(x.path) and html_crf._id("any main") in html_crf.path_features(y.path)
    assert html_crf._id("any main") not in html_crf.path_features(z.path) and html_crf._id("any ul") not in html_crf.path_features(y.path)
    import time

    began = time.time()
    html_crf.blocks("<svg>" * 60_000 + "<title>" * 60_000 + "</b>" * 60_000 + "<i1>" * 60_000)
    assert time.time() - began < 20  # in proportion to the length


def brute_chain(scores, moves, start):
    """Log of the sum over all labellings, and the probabilities of label 1 by block."""
    import itertools

    every = list(itertools.product((0, 1), repeat=len(scores)))
    v = np.array([start[y[0]] + sum(s for s, k in zip(scores, y, strict=True) if k) + sum(moves[a][b] for a, b in zip(y, y[1:], strict=False)) for y in every])
    z = np.logaddexp.reduce(v)
    return z, (np.exp(v - z)[:, None] * np.array(every)).sum(0)


@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.lists(st.floats(-2, 2), min_size=6, max_size=6))
@settings(max_examples=100, deadline=None)
def test_marginals_equal_brute_force(scores, w):
    node = np.array([[0.0, s] for s in scores])
    moves, start = np.array([w[:2], w[2:4]]), np.array(w[4:])
    z, p, pair = html_crf.marginals(node, moves, start)
    want_z, want = brute_chain(scores, moves.tolist(), start.tolist())
    assert np.isclose(z, want_z) and np.allclose(p[:, 1], want) and np.allclose(p.sum(1), 1)
    if len(scores) > 1:
        assert np.allclose(pair.sum((1, 2)), 1) and np.allclose(pair.sum(1)[:, 1], want[1:]) and np.allclose(pair.sum(2)[:, 1], want[:-1])


def test_extraction_query_equals_a_plain_decoder(spark):
    """The whole query against blocks, summed weights and the best of all labellings found by a plain dynamic programme."""
    pages, docs = table(spark, TINY, "pages"), table(spark, TINY, "documents")
    model = html_crf.train(pages, docs)
    got = {r.page_id: r for r in html_crf.extract(pages, docs).collect()}
    rows = pages.collect()
    assert len(rows) == len(got)
    for r in rows:
        found = html_crf.blocks(r.html)
        best = {k: (model.start[k], [k]) for k in (0, 1)}
        for i, s in enumerate(model.scores(found)):
            if i:
                best = {k: max(((best[j][0] + model.moves[j][k], best[j][1] + [k]) for j in (0, 1)), key=lambda x: (x[0], -x[1][-2])) for k in (0, 1)}
            best[1] = (best[1][0] + s, best[1][1])
        y = best[1][1] if found and best[1][0] > best[0][0] else best[0][1]
        assert got[r.page_id].text == "\n".join(b.text for b, k in zip(found, y, strict=False) if k and found)


def test_blocks_of_pages_without_optional_or_closing_tags():
    texts = lambda page: [b.text for b in html_crf.blocks(page)]
    assert texts("<html><head><title>t</title><meta x><p>a</p>b") == ["a", "b"]
    assert texts("<head><title>t<p>a</p></html>") == ["a"] and texts("<title>t<div>a") == ["a"]
    assert texts("<head><title>a <b> c</title><style>x</style></head>d") == ["d"]
    for name in ("svg", "noscript", "template", "textarea"):
        assert texts(f"<p>a</p><{name}><p>b") == ["a", "b"]
    assert texts("<p>a</p><script>b<p>c") == ["a"]


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>a<p>b</div></p><b>c"), (4, "u", "<div " * 1000), (5, "u", "<ul>" * 3000 + "x"), (6, "u", "a < b &amp; c<!-- x -->"), (6, "u", "a < b &amp; c<!-- x -->"), (None, "u", "<script>no</script>yes")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "html as text")
    docs = odd(spark)
    got = {r.page_id: r for r in html_crf.extract(pages, docs).collect()}
    assert got[1].text is None and got[2].text == "" and got[3].n_blocks == 3
    assert got[6].text == "a < b & c" and got[None].text == "yes"
    assert html_crf.extract(pages, docs).count() == 8 and html_crf.extract(pages.limit(0), docs).count() == 0
