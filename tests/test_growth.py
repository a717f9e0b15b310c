"""What keeps a scan's tasks short however large the tables are: one search for keywords, one scan a query, bounded shares of the texts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from hushgrid.catalogue import Pattern, Registry, builtin, literal_first
from hushgrid.functions import text as tx
from hushgrid.operators.scan import ScanOptions, prefilter, raw_findings, shared
from hushgrid.plans import corpus, queries

from conftest import TINY


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def searched(spark, texts, registry):
    files = spark.createDataFrame(list(enumerate(texts)), "path int, content string")
    java = F.array_distinct(F.regexp_extract_all(tx.ascii_lower(F.col("content")), F.lit(registry.prefilter()), F.lit(0)))
    return [(r.hits, r.java) for r in prefilter(files, registry).withColumn("java", java).orderBy("path").collect()]


def test_search_finds_what_the_jvms_regex_finds(spark):
    words = sorted({w for p in builtin() for w in p.keywords})
    r = random.Random(5)
    texts = ["".join(r.choice([r.choice(words), r.choice(words)[:-1], r.choice(words).swapcase(), " ", "é", "\n", "\0", "K", "ſ", "😀"]) for _ in range(r.randrange(12))) for _ in range(400)]
    got = searched(spark, [None, "", "KEY aſia", "sk-ANT- sk-", *texts], Registry())
    assert got[0] == (None, None) and got[1] == ([], []) and got[3][0] == ["sk-ant-", "sk-"]
    assert all(hits == java for hits, java in got) and sum(map(bool, (h for h, _ in got))) > 100


def test_search_takes_any_keywords(spark):
    odd = Registry((Pattern("a/b", "x", "low", "x", ("é$.", "É", "a b", "^")), Pattern("a/c", "x", "low", "x", ("éa",))))
    assert all(hits == java for hits, java in searched(spark, ["é$.É éA", "A B^", "a", None, "É$."], odd))
    none = Registry((Pattern("a/b", "x", "low", "x"),))
    assert [h for h, _ in searched(spark, ["a", None], none)] == [[], None]
    assert [h for h, _ in searched(spark, ["a", None], Registry((Pattern("a/b", "x", "low", "x", ("",)),)))] == [[""], None]
    many = Registry((Pattern("a/b", "x", "low", "x", tuple(f"{n * 7919 % 1000003:06d}{n:b}{n * 31:x}" for n in range(30_000))),))  # beyond RE2's size
    assert [h for h, _ in searched(spark, ["x 0000000000 Y", "no", None], many)] == [["00000000"], [], None]


def test_literal_first_keeps_the_matches(spark):
    java = spark.sparkContext._jvm.java.util.regex.Pattern

    def spans(regex, text):
        m, out = java.compile(regex).matcher(text), []
        while m.find():
            out.append((m.start(), m.end()))
        return out

    lines = [x for _, x in corpus.samples()]
    changed = 0
    for p in builtin():
        quick = literal_first(p.regex)
        if quick != p.regex:
            changed += 1
            word = re.match(r"[A-Za-z0-9_-]+", quick)[0]
            own = next(x for found, x in zip((f for f, _ in corpus.samples()), lines) if p.id in {i for i, _ in found})
            for text in (own, f"a{own}", f"é{own} {own}", own.replace(word, f"x{word}"), own.replace(word, word + word), f"{own}\n{own}_", own.replace(word, f".{word}")):
                assert spans(quick, text) == spans(p.regex, text), (p.id, text)
    assert changed > 80
    for regex in (r"\b(a)(b)\b", r"\b(a|b)\b", r"\b(ab\d+)\b", "(?i)abc", r"\b(a?b)\b"):
        assert literal_first(regex) == regex or spans(literal_first(regex), "ab b a abb") == spans(regex, "ab b a abb")
    assert spans(literal_first(r"\b(ab{2}c)\b"), "abbc xabbc abc") == [(0, 4)]


def test_places_of_secrets_that_stand_there_more_than_once(spark):
    r = Registry((Pattern("c/t", "t", "low", r"\b(tok_[a-z]{3})\b", ("tok_",)),))
    texts = ["xtok_abc tok_abc", "tok_abc tok_abc", "é tok_abc\ntok_abcd tok_abd", " ".join(f"tok_{c}{c}{c}" for c in "abcdefgh"), "tok_abctok_abc tok_abc"]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    got = sorted((int(x.path), x.byte_start, x.byte_end) for x in raw_findings(files, ScanOptions(r)).collect())
    want = sorted((i, *(len(t[:k].encode()) for k in m.span())) for i, t in enumerate(texts) for m in re.finditer(r"\b(tok_[a-z]{3})\b", t))
    assert got == want


@pytest.mark.parametrize("name", ["baseline_suppressed", "baseline_upsert", "scan_stats", "editor_actions", "editor_hover", "verification"])
def test_a_query_scans_its_texts_once(spark, name):
    df = queries.QUERIES[name](spark, TINY)
    df.collect()
    assert plan_of(df).count("ArrowEvalPython") == 1, name


def test_shared_rows_are_the_same_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (None, None), (1, "a")], "k int, v string")
    assert sorted(map(str, shared(rows, "k").collect())) == sorted(map(str, rows.collect()))


def test_shares_of_a_table_are_bounded(spark, monkeypatch):
    size = sum(corpus.row_groups(f"{TINY}/documents.parquet"))
    monkeypatch.setattr(corpus, "TASK_BYTES", size // 100)
    rows = corpus.spread_table(spark, TINY, "documents")
    assert rows.rdd.getNumPartitions() >= 100
    each = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(each) == rows.count() and max(each) <= 4 * sum(each) / len(each)


#: F4, F5, F15, F16, F17
LONGEST = ["fix_ignore", "fix_placeholder", "scan_high_confidence", "editor_diagnostics", "findings_by_label"]


@pytest.mark.parametrize("name", LONGEST)
def test_a_query_deals_its_texts_out_by_place(spark, monkeypatch, name):
    """One exchange of texts, below the search, to shares of the bound; the tasks that deal out don't sort."""
    want = sorted(map(str, queries.QUERIES[name](spark, TINY).collect()))
    size = sum(corpus.row_groups(f"{TINY}/documents.parquet"))
    monkeypatch.setattr(corpus, "TASK_BYTES", size // 100)
    df = queries.QUERIES[name](spark, TINY)
    assert sorted(map(str, df.collect())) == want
    plan = plan_of(df)
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(_extract_file_path#\d+, _extract_row_index#\d+L?, (\d+)\)", plan)]
    assert len(dealt) == 1 and dealt[0] >= 100 and "RoundRobin" not in plan
    assert plan.index("ArrowEvalPython") < plan.index("_extract_row_index")


def test_rows_without_keys_and_equal_rows_are_dealt_out_evenly(spark, monkeypatch, tmp_path):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus, "TASK_BYTES", 64)
    dealt = corpus.spread_table(spark, str(tmp_path), "documents")
    each = [r[1] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert dealt.columns == ["doc_id", "text"] and sum(each) == 4000 and max(each) <= 3 * 4000 / dealt.rdd.getNumPartitions()
