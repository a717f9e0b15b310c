"""Duplicates against brute force, with planted copies and odd rows."""

from __future__ import annotations

import os
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from hushgrid.llm import exact_dedup, graph, joins, line_dedup, minhash, packing, pivots, queries
from hushgrid.llm.common import fresh, materialise, row_bytes, scratch, small_side, table

from conftest import TINY

DOCS = "doc_id long, text string, digest string, lang string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame([(*r, "d", "l")[:4] for r in rows], schema)


def pairs(df):
    return sorted(((r[0], r[1]) for r in df.collect()), key=str)


def test_exact_copies(spark):
    rows = [(5, "a"), (3, "a"), (3, "a"), (None, "a"), (7, "b"), (8, None), (9, None), (1, ""), (2, ""), (4, "x" * 100_000), (6, "x" * 100_000), (10, "A")]
    want = [(3, None), (3, 3), (3, 5), (3, None), (7, None), (8, None), (9, None), (1, None), (1, 2), (4, None), (4, 6), (10, None)]
    assert pairs(exact_dedup.copies(frame(spark, rows))) == sorted(want, key=str)
    kept = exact_dedup.keep_first(frame(spark, rows))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r.doc_id for r in kept.collect())) == [1, 3, 4, 7, 8, 9, 10]
    assert exact_dedup.copies(frame(spark, [])).count() == 0 and exact_dedup.keep_first(frame(spark, [])).count() == 0


def test_exact_copies_are_merged_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RANGE_ROWS", 50)
    rng = random.Random(3)
    rows = [(i, f"t{rng.randrange(80)}") for i in range(400)]
    first = {}
    for i, t in rows:
        first[t] = min(i, first.get(t, i))
    want = sorted(((first[t], None if first[t] == i else i) for i, t in rows), key=str)
    assert pairs(exact_dedup.copies(frame(spark, rows).repartition(13))) == want


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), min_size=1, max_size=40))
@settings(max_examples=100, deadline=None)
def test_merging_runs_keeps_the_smallest_of_each_text(rows):
    runs = []
    for part in (rows[::3], rows[1::3], rows[2::3]):  # digests collide: texts 0 and 2, and 1 and 3, differ in their SHA alone
        part = sorted(part, key=lambda r: r[0] % 2)
        column = lambda x: np.array(x, np.int64)
        one = column([1] * len(part))
        runs.append({"digest": column([k % 2 for k, _ in part]), "sha": np.array([[k] * 4 for k, _ in part], np.uint64).reshape(-1, 4), "size": one, "null": one == 0, "doc_id": column([d for _, d in part]), "row": 0 * one, "n": one, "same": one})
    got = exact_dedup.merge(runs)
    want = {k: (min(d for j, d in rows if j == k), sum(j == k for j, _ in rows)) for k, _ in rows}
    assert {int(s[0]): (d, n) for s, d, n in zip(got["sha"], got["doc_id"].tolist(), got["n"].tolist(), strict=True)} == want
    same = {k: sum(r == (k, want[k][0]) for r in rows) for k in want}
    assert dict(zip(got["sha"][:, 0].tolist(), got["same"].tolist(), strict=True)) == same and (np.diff(got["digest"]) >= 0).all()


def shingles(t):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_groups(sets, threshold):
    ids = sorted(i for i, s in sets.items() if s)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = [(1, None), (2, ""), (3, "!!"), (4, "one two"), (5, "Two, one"), (6, "ONE two"), (7, "tie tie"), (7, "tie tie"), (None, "one two")]
    i = 10
    passage = " ".join(rng.choices(words, k=70))
    for size, edits in ((40, 1), (80, 4), (200, 3), (200, 25), (3000, 50)):
        base = rng.choices(words, k=size)
        for _ in range(6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(size)] = rng.choice(words)
            rows.append((i, " ".join(copy)))
            i += 1
    for _ in range(10):  # a passage that many share makes no copies
        rows.append((i, passage + " " + " ".join(rng.choices(words, k=120))))
        i += 1
    got = {r.node: r.root for r in minhash.groups(frame(spark, rows)).collect()}
    want = {a: b for a, b in brute_groups({a: shingles(t) for a, t in rows if a is not None}, minhash.THRESHOLD).items() if a != b}
    assert got == want and len(want) > 12
    kept = minhash.keep_one(frame(spark, rows))
    assert kept.count() == len(rows) - sum(r[0] in got for r in rows) and kept.columns[2] == "digest"
    assert minhash.copies(frame(spark, [])).count() == 0


def test_recall_of_copies_with_changed_words(spark):
    """Copies with 5 to 10 % of their words changed go; texts that share a third of their words in a passage stay."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    rows, planted = [], set()
    for share in (0.05, 0.07, 0.1):
        for size in (60, 150, 400, 2000):
            for _ in range(5):
                base = rng.choices(words, k=size)
                copy = list(base)
                for k in rng.sample(range(size), round(share * size)):
                    copy[k] = "changed" + words[k]
                planted.add(len(rows) + 1)
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    passage = " ".join(rng.choices(words, k=60))
    rows += [(len(rows) + k, passage + " " + " ".join(rng.choices(words, k=120))) for k in range(20)]
    got = {r.node: r.root for r in minhash.groups(frame(spark, rows)).collect()}
    assert set(got) <= planted and all(got[i] == i - 1 for i in got) and len(got) >= 0.95 * len(planted)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


@given(st.lists(st.tuples(st.text("abé", max_size=14), st.text("abé", max_size=14)), min_size=1, max_size=12), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_banded_distance(words, edits):
    codes = lambda s: np.array([ord(c) for c in s], np.int32)
    got = line_dedup.edit_distances([codes(a) for a, _ in words], [codes(b) for _, b in words], edits)
    assert got.tolist() == [min(edits + 1, distance(a, b)) for a, b in words]


@given(st.lists(st.tuples(st.text("abé🙂", min_size=1, max_size=14), st.text("abé🙂", min_size=1, max_size=14)), min_size=1, max_size=12), st.integers(1, 3))
@settings(max_examples=100, deadline=None)
def test_lines_within_the_edits_are_alike(words, edits):
    got = line_dedup.alike([a.encode() for a, _ in words], [b.encode() for _, b in words], edits)
    assert all(g for g, (a, b) in zip(got, words, strict=True) if distance(a, b) <= edits)


def test_lines_of_the_jvm_and_of_the_worker_have_equal_hashes(spark):
    from hushgrid.llm import textkern as tk

    texts = ["a\n b \u00a0\n\n\u2003x y\t\r\n", "", "\n", "é\u0085\n🙂 z", "no feed"]
    want = {(r.doc_id, r.line): (r.id, r.words) for r in line_dedup.placed(frame(spark, list(enumerate(texts))).select("doc_id", "text"), "doc_id").collect()}
    got = {}
    for i, s in enumerate(texts):
        raw = np.frombuffer(s.encode(), np.uint8)
        t = tk.Text(raw, np.array([0, len(raw)]))
        _, number, a, b = line_dedup.lines(t)
        chars = s
        got |= {(i, int(k)): (int(h), chars[p:q]) for k, h, p, q in zip(number, line_dedup.own_ids(t, a, b), a, b, strict=True)}
    assert got == want and len(want) == 6


def test_near_lines_equal_brute_force(spark):
    rng = random.Random(2)
    alphabet = "abcdefgh é"
    base = ["".join(rng.choices(alphabet, k=rng.randrange(30, 60))).strip().ljust(30, "z") for _ in range(12)]
    lines = []
    for s in base:
        for edits in (0, 1, 2, 3):
            t = list(s)
            for _ in range(edits):
                k = rng.randrange(1, len(t) - 1)
                t[k : k + rng.choice((0, 1))] = rng.choice(("", "q", "r"))
            lines.append("".join(t))
    rng.shuffle(lines)
    rows = [(k, "\n".join(lines[4 * k : 4 * k + 4])) for k in range(12)] + [(50, None), (51, ""), (52, "short\nshort\n\n"), (None, base[0]), (3, "\n".join(lines[12:16])), (60, f"  {lines[0]}\t\n{lines[0]}")]
    where = sorted({(i, n, t.strip()) for i, text in rows if i is not None for n, t in enumerate((text or "").split("\n")) if len(t.strip()) >= line_dedup.MIN_CHARS})
    distinct = sorted({t for _, _, t in where})
    root = {t: t for t in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                root[find(a)] = find(b)
    first, want = {}, set()
    for i, n, t in where:
        f = first.setdefault(find(t), (i, n))
        if f != (i, n):
            want.add((i, n, *f))
    assert {tuple(r) for r in line_dedup.dedup(frame(spark, rows)).collect()} == want and len(want) > 20
    assert line_dedup.dedup(frame(spark, [])).count() == 0


def test_short_lines_equal_brute_force(spark):
    rng = random.Random(6)
    lines = ["", "}", "}", "}", "ab", "ac", "The end.", "The end.", "The End.", "All rights reserved.", "All rights reserved.", "All right reserved.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0"]
    for size in [*range(1, 34)] * 3:
        s = rng.choices("abcdefgh é", k=size)
        for edits in (0, 0, 1, 2, 3):
            t = list(s)
            for _ in range(edits):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.choice((0, 1))] = rng.choice(("", "q", "r"))
            lines.append("".join(t))
    rng.shuffle(lines)
    rows = [(k, "\n".join(lines[5 * k : 5 * k + 5])) for k in range(len(lines) // 5 + 1)]
    where = sorted((i, n, t.strip()) for i, text in rows for n, t in enumerate(text.split("\n")) if t.strip())
    distinct = sorted({t for _, _, t in where})
    root = {t: t for t in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            most = min(2, min(len(a), len(b)) // 10)
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                root[find(a)] = find(b)
    first, want = {}, set()
    for i, n, t in where:
        f = first.setdefault(find(t), (i, n))
        if f != (i, n):
            want.add((i, n, *f))
    assert {tuple(r) for r in line_dedup.dedup(frame(spark, rows)).collect()} == want
    short = {(i, n): t for i, n, t in where}
    assert sum(len(short[w[:2]]) < 30 for w in want) > 100 and sum(short[w[:2]] != short[w[2:]] for w in want) > 50


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 32))
    near = base[:40] + 0.05 * rng.standard_normal((40, 32))
    x = np.concatenate([base, near, near[:5]]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [1.0]), (None, rows[0][1]), (0, rows[0][1]), (904, [])]
    vectors = spark.createDataFrame([(*r, 1, "q") for r in rows], "vec_id long, embedding array<float>, label int, keep string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= pivots.THRESHOLD
    want = {i: int(np.flatnonzero(close[i])[0]) for i in range(len(x)) if np.flatnonzero(close[i])[0] < i}
    got = {r.node: r.root for r in pivots.groups(vectors).collect()}
    assert set(got) <= set(want) and sum(got.get(i) == w for i, w in want.items()) >= 0.9 * len(want) and len(want) >= 40
    ids = [r.vec_id for r in pivots.copies(vectors).where("copy_id is null").collect()]
    assert {900, 901, 902, 903} <= set(ids) and len(ids) == len(set(ids))
    assert pivots.copies(vectors.limit(0)).count() == 0


def test_pivot_recall_over_the_table(spark):
    """Each vector of the table with a planted copy just within the threshold; the table itself has no pair that near."""
    rows = table(spark, TINY, "embeddings").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = np.random.default_rng(0).standard_normal(x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.955 * x + (1 - 0.955**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<float>")
    got = {r.node: r.root for r in pivots.groups(vectors).collect()}
    assert np.mean([got.get(i + len(x)) == i for i in range(len(x))]) >= 0.9 and len(got) <= len(x)


def test_fresh_names():
    assert fresh(["Digest", "_digest"], "digest") == "__digest"


def test_pipeline_equals_its_stages_by_hand(spark):
    docs = table(spark, TINY, "documents")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in at.select("doc_id", "text").collect()}
        at = stage(spark, at, TINY)
        assert at.columns == docs.columns
        at = spark.createDataFrame(at.collect(), docs.schema)
        after = {r.doc_id: r.text for r in at.select("doc_id", "text").collect()}
        assert set(after) <= set(before)
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(before[i], i)
            assert set(after) == set(first.values())
        if name == "minhash_near_dedup":
            roots = brute_groups({i: shingles(t) for i, t in before.items()}, minhash.THRESHOLD)
            gone = {i for i, r in roots.items() if r != i}
            assert gone and not (set(before) - set(after)) - gone and len(set(before) - set(after)) >= 0.98 * len(gone)
    want = {tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, at, TINY).collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, TINY).collect()} == want and want


def test_minhash_query_equals_brute_force(spark):
    got = {(r.copy_id, r.doc_id) for r in queries.QUERIES["op8_minhash_near_dedup"](spark, TINY).collect()}
    roots = brute_groups({r.doc_id: shingles(r.text) for r in table(spark, TINY, "documents").collect()}, minhash.THRESHOLD)
    every = {r.doc_id for r in table(spark, TINY, "documents").collect()}
    gone = {(i, r) for i, r in roots.items() if i != r}
    assert gone and got == gone | {(None, i) for i in every - {i for i, _ in gone}}


def test_pivot_query_against_brute_force(spark):
    """All pairs of the table that are near, at the production threshold and at one that the table has many pairs of."""
    rows = table(spark, TINY, "embeddings").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = queries.QUERIES["op3_embedding_near_dedup"](spark, TINY).collect()
    assert sorted(r.vec_id if r.copy_id is None else r.copy_id for r in got) == sorted(r.vec_id for r in rows)
    ids = [r.vec_id for r in rows]
    for threshold in (pivots.THRESHOLD, 0.9):
        near = {(ids[i], ids[j]) for i, j in np.argwhere(np.triu(x @ x.T >= threshold, 1))}
        found = {r.node: r.root for r in pivots.groups(table(spark, TINY, "embeddings"), threshold).collect()}
        linked = [found.get(a, a) == found.get(b, b) for a, b in near]
        assert not near or np.mean(linked) >= 0.9
        root = {i: i for i in ids}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in near:
            p, q = sorted((find(a), find(b)))
            root[q] = p
        assert all(find(a) == find(b) for a, b in found.items())  # nothing is linked that isn't near


def test_line_query_equals_brute_force(spark):
    """The whole query; pairs whose counts of characters differ too much for the edits are left out before the distances."""
    docs = sorted((r.doc_id, r.text or "") for r in table(spark, TINY, "documents").collect())
    where = [(i, n, t.strip()) for i, text in docs for n, t in enumerate(text.split("\n")) if t.strip()]
    distinct = sorted({t for _, _, t in where})
    size = np.array([len(t) for t in distinct])
    bags = np.zeros((len(distinct), 64), np.int16)
    for k, t in enumerate(distinct):
        np.add.at(bags[k], [ord(c) % 64 for c in t], 1)
    root = {t: t for t in distinct}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for k, t in enumerate(distinct):
        most = np.minimum(line_dedup.EDITS, np.minimum(size[k], size[k + 1 :]) // line_dedup.CHARS_PER_EDIT)
        near = np.flatnonzero((np.abs(size[k + 1 :] - size[k]) <= most) & (most > 0))
        near = near[np.abs(bags[k + 1 :][near] - bags[k]).sum(1) <= 2 * most[near]]
        for j in near:
            if distance(t, distinct[k + 1 + j]) <= most[j]:
                root[find(t)] = find(distinct[k + 1 + j])
    first, want = {}, set()
    for i, n, t in where:
        f = first.setdefault(find(t), (i, n))
        if f != (i, n):
            want.add((i, n, *f))
    assert {tuple(r) for r in queries.QUERIES["op6_line_dedup"](spark, TINY).collect()} == want and len(want) > 20


def brute_pairs(rows, joined):
    return {tuple(sorted((p[1], q[1]))) for p in rows for q in rows if p[0] == q[0] and p[1] != q[1] and joined(p, q)}


def test_long_keys_lose_no_pair(spark, monkeypatch):
    """Keys of more rows than a task pairs, beside short ones, are cut into blocks."""
    monkeypatch.setattr(joins, "CHUNK", 50)
    monkeypatch.setattr(joins, "LIMIT", 30)
    monkeypatch.setattr(joins, "BLOCK", 8)
    rng = random.Random(7)
    keys = [1] * 200 + [2] * 45 + [3] * 31 + [4] * 30 + [*range(5, 60)] * 3
    rows = [(k, i, rng.choice((0, 0, 1, 2))) for i, k in enumerate(keys)] + [(1, 3, 2), (1, 3, 0), (2, 210, 2)]
    got = {tuple(r) for r in joins.two_sided_pairs(spark.createDataFrame(rows, "key long, id long, left int").repartition(3)).collect()}
    assert got == brute_pairs(rows, lambda p, q: p[2] < 2 and q[2] > 0 or q[2] < 2 and p[2] > 0)
    rows = [(k, i, i if rng.random() < 0.2 else k, rng.randrange(4)) for i, k in enumerate(keys)]
    rows += [(70, i, 70, 0) for i in range(1000, 1100)]  # one root: no pair
    got = {tuple(r) for r in joins.one_sided_pairs(spark.createDataFrame(rows, "key long, id long, root long, size long"), ["size"], lambda p, x, y: p[0][x] == p[0][y]).collect()}
    assert got == brute_pairs(rows, lambda p, q: p[2] != q[2] and p[3] == q[3])


def test_lines_that_many_texts_share_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "REPEATS", 5)
    shared, near = "All rights reserved by the authors.", "All rights reserved by the author."
    rows = [(i, f"own line number {i * 7919:09d}\n{shared}") for i in range(40)] + [(100, near), (101, shared)]
    got = {(r.doc_id, r.line): (r.of_doc, r.of_line) for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert {got[i, 1] for i in range(1, 40)} == {(0, 1)} and got[100, 0] == got[101, 0] == (0, 1)


def test_long_lines_and_clashing_names(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh ", k=150_000)).strip()
    swapped = "x" * 70_000 + "y" * 70_000, "y" * 70_000 + "x" * 70_000
    rows = [(1, long), (2, long[:70_000] + "Z" + long[70_001:]), (3, long[5:]), (4, swapped[0]), (5, swapped[1]), (6, swapped[0][:-1]), (7, "tie line of words\ntie line of words"), (7, "tie line of words")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "doc_id long, text string, id long, line long, key long, node string")
    got = {tuple(r) for r in line_dedup.dedup(docs).collect()}
    assert got == {(2, 0, 1, 0), (6, 0, 4, 0), (7, 1, 7, 0)}


def test_near_copies_of_long_texts_and_clashing_names(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    long = rng.choices(words, k=60_000)
    copy = [w if k % 50 else "changed" for k, w in enumerate(long)]
    rows = [(9, " ".join(long)), (4, " ".join(copy)), (7, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (8, "b c d e f a"), (None, "a b c d e f")]
    # 3, 7: equal; 8: half of its four trigrams are shared: 3 of 5, above the threshold
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], "doc_id long, text string, gone_id long, size long, sketch string, root string")
    assert {(r.node, r.root) for r in minhash.groups(docs).collect()} == {(9, 4), (7, 3), (8, 3)}
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "4", "None"]


def test_equal_cosines_and_clashing_names(spark):
    rows = [(k, v) for k, v in enumerate(([1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [2.0, 0.0], [0.0, -1.0]))] + [(4, [2.0, 0.0])]
    vectors = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, id long, code long, root string")
    assert {(r.node, r.root) for r in pivots.groups(vectors).collect()} == {(1, 0), (4, 0)}
    assert {(r.node, r.root) for r in pivots.groups(vectors, 1.0).collect()} == {(1, 0), (4, 0)}  # a cosine equal to the threshold is near


def test_pivot_orders():
    rng = np.random.default_rng(3)
    a, b = (np.stack([rng.permutation(9)[:7] for _ in range(50)]) for _ in range(2))
    assert (pivots.unpacked(*pivots.packed(a)) == a).all()
    shared, far = pivots.moved(a, b)
    for x, y, n, f in zip(a.tolist(), b.tolist(), shared, far, strict=True):
        place = lambda r, p: r.index(p) if p in r else pivots.PREFIX
        assert n == len(set(x) & set(y)) and f == sum(abs(place(x, p) - place(y, p)) for p in set(x) | set(y))
    few = np.stack([rng.permutation(3) for _ in range(9)])
    shared, far = pivots.moved(pivots.unpacked(*pivots.packed(few)), pivots.unpacked(*pivots.packed(few[::-1])))
    assert (shared == 3).all() and far.max() <= 4
    assert pivots.most_bits(0.95) == 17 and pivots.most_bits(0.5) > 32 and pivots.n_pivots(10**10) > 10_000


def test_estimates_follow_the_threshold():
    assert 0.33 < minhash.least_estimate(0.5) < 0.35 and minhash.least_estimate(0.9) > 0.8 and minhash.least_estimate(0.05) == 1 / minhash.K


def test_broadcasts_are_bounded_in_bytes(spark):
    ids = spark.range(1000).select("id")
    assert row_bytes(ids) == 40 and row_bytes(ids.selectExpr("id", "struct(id, id) as s")) == 72
    plan = lambda most: ids.join(small_side(ids.selectExpr("id as other"), most), ids["id"] == F.col("other"))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(40_000).lower() and "broadcast" not in plan(39_999).lower()


def test_scratch_deletes_what_is_left(spark, tmp_path):
    with scratch(spark):
        left = materialise(spark.range(3))
        kept = materialise(spark.range(4), scoped=False)
    assert kept.count() == 4 and not os.path.exists(left._hushgrid_path.removeprefix("file://"))


def test_pipeline_over_odd_rows(spark, tmp_path):
    sf = str(tmp_path)
    text = "The house stands at the end of the road, and the garden behind it is full of old trees. "
    more = "El perro corre por la calle y la gente mira desde las ventanas de la casa vieja. "
    rows = [(i, f"{(text if i % 2 else more) * 2}{i} " + " ".join(f"{'word' if i % 2 else 'palabra'}{i}x{k}" for k in range(20)), "en" if i % 2 else "es", "s", 1) for i in range(60)]
    rows += [(100, None, "en", None, None), (101, "", None, None, None), (102, "12 34 !!", "en", "s", 1), (None, rows[1][1], None, None, None), (1, rows[1][1], "en", "s", 1), (103, rows[1][1], "en", "s", 1), (104, "a very long one " * 20_000, "en", "s", None)]
    extra = [(*r, "x", 7, "y") for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone_id string, digest long, text_to_score string"
    spark.createDataFrame(extra, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {*range(60), 104}
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0
        if name != "best_fit_packing":
            assert stage(spark, docs, sf).columns == docs.columns


def test_odd_rows_of_the_token_operators(spark):
    from hushgrid.llm import bpe, html_crf, langid, prefix_counts, quality_fm

    names = "doc_id long, text string, lang string, source string, ids string, n_tokens string, deltas string, shard string, bin string, predicted string, kept string, text_to_identify string"
    rows = [(1, "same words here", "en", "s"), (1, "same words here", "en", "s"), (2, None, None, None), (None, "", "de", "s")]
    docs = spark.createDataFrame([(*r, *"abcdefgh") for r in rows], names)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for made in (bpe.encode, prefix_counts.count, langid.identify, lambda d: quality_fm.classify(d, labels)):
        got = [tuple(r) for r in made(docs).collect()]
        assert len(got) == 4 and len(set(map(str, got))) == 3 and made(docs.limit(0)).count() == 0
    counted = prefix_counts.count(docs.limit(0))
    assert counted.select(prefix_counts.tokens_at(3), prefix_counts.chars_within(3)).count() == 0
    assert langid.keep_accepted(docs).columns == docs.columns and quality_fm.keep_good(docs, labels).columns == docs.columns
    assert {(r.doc_id, r.n_tokens) for r in packing.pack(docs).collect()} == {(1, 3)} and packing.pack(docs).count() == 2
    pages = docs.selectExpr("doc_id as page_id", "source as url", "text as html", "ids as text", "bin as n_blocks")
    assert html_crf.extract(pages, docs).count() == 4
    # ties: two languages with the same texts are equally likely, the first in the alphabet is said
    tied = spark.createDataFrame([(i, "uno due tre", g) for i in range(40) for g in ("b", "a")], "doc_id long, text string, lang string")
    assert {r.predicted for r in langid.identify(tied).collect()} <= {"a", "b"}
    model = langid.Model(["a", "b"], np.zeros((langid.BINS, 2)), np.zeros(2), np.ones(langid.BINS))
    import pyarrow as pa

    assert langid.predict(model, pa.array(["uno due"]))[0] == ["a"]
    assert quality_fm.kept(np.array([0.5]), np.array([0.5]), 1, 0.5, 0.5).all()
