"""The scan's rules, with in-line files."""

from __future__ import annotations

import re
from hashlib import sha256

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushgrid.catalogue import Pattern, PatternError, Registry, ascii_lower, builtin, check_regex, severity, trie_regex
from hushgrid.functions import text as tx
from hushgrid.operators.assignments import code_values, dotenv_values, is_trigger
from hushgrid.operators.scan import ScanOptions, at_least, context_lines, prefilter, raw_findings, scan

SECRET = Registry((Pattern("custom/secret", "Secret", "high", r"SECRET_[A-Z]{8}", ("secret_",)), Pattern("custom/key", "Key", "low", r"KEY_[A-Za-z]{20}", ("key_",), 3.5)))


def found(spark, rows, options=None, columns=("path", "line", "column", "byte_start", "byte_end", "pattern_id", "confidence", "masked_line")):
    files = spark.createDataFrame(rows, "path string, content string")
    return [tuple(r) for r in scan(files, options or ScanOptions(SECRET)).select(*columns).orderBy("path", "byte_start", "pattern_id").collect()]


def test_catalogue():
    p = builtin()
    assert len({x.id for x in p}) == len(p) >= 141
    assert all(x.keywords and re.compile(x.regex) for x in p)
    assert severity(" HIGH ") == "high"
    with pytest.raises(PatternError):
        severity("huge")


def test_regexes_are_checked(spark):
    check_regex(spark, "a+")
    for bad in ("(", "a*"):
        with pytest.raises(PatternError):
            check_regex(spark, bad)
    for p in builtin():
        check_regex(spark, p.regex)


@given(st.lists(st.text("abc-", min_size=1, max_size=4), min_size=1, max_size=8), st.text("abc-", max_size=30))
@settings(max_examples=300, deadline=None)
def test_trie_finds_the_leftmost_longest_keywords(words, text):
    want, at = [], 0
    while at < len(text):
        hit = max((w for w in words if text.startswith(w, at)), key=len, default=None)
        if hit:
            want.append(hit)
        at += len(hit) if hit else 1
    assert re.findall(trie_regex(sorted(set(words))), text) == want


def test_prefilter_hides_shorter_keywords(spark):
    files = spark.createDataFrame([("a", "x sk-ANT-y dd_api_key TWILIO_ACCOUNT")], "path string, content string")
    hits = set(prefilter(files, Registry()).first()["hits"])
    assert {"sk-ant-", "dd_api"} <= hits and not hits & {"sk-", "api_key", "twilio"}


def test_positions_masks_and_markers(spark):
    rows = [("a", "line1\nkey = SECRET_ABCDEFGH\nline3"), ("b", "é SECRET_ABCDEFGH // hushgrid:ignore\nü SECRET_ABCDEFGH SECRET_ABCDEFGI"), ("c", "SECRET_ABC"), ("d", None), ("e", "")]
    assert found(spark, rows) == [
        ("a", 2, 7, 12, 27, "custom/secret", "high", "key = SE••••••••GH"),
        ("b", 2, 3, 41, 56, "custom/secret", "high", "ü SE••••••••GH SECRET_ABCDEFGI"),
        ("b", 2, 19, 57, 72, "custom/secret", "high", "ü SECRET_ABCDEFGH SE••••••••GI"),
    ]


def test_low_entropy_lowers_confidence_only(spark):
    rows = [("a", "KEY_aBcDeFgHiJkLmNoPqRsT"), ("b", "KEY_XXXXXXXXXXXXXXXXXXXX")]
    assert [(r[0], r[6]) for r in found(spark, rows)] == [("a", "high"), ("b", "low")]
    files = spark.createDataFrame(rows, "path string, content string")
    assert [r.path for r in at_least(scan(files, ScanOptions(SECRET))).collect()] == ["a"]
    assert not scan(files, ScanOptions(SECRET, severity="high")).count()


def test_multi_line_match_counts_at_its_first_line(spark):
    r = Registry((Pattern("custom/pem", "Pem", "high", r"BEGIN[\s\S]{3,}?END", ("begin",)),))
    rows = [("a", "x BEGIN\nabc\nEND y"), ("b", "BEGIN hushgrid:ignore\nabc\nEND"), ("c", "BEGIN\nabc\nEND hushgrid:ignore")]
    assert [(x[0], x[1], x[2], x[7]) for x in found(spark, rows, ScanOptions(r))] == [("a", 1, 3, "x BE••••••••ND"), ("c", 1, 1, "BE••••••••ND")]


def test_binary_is_a_nul_in_the_first_8000_bytes(spark):
    rows = [("a", "SECRET_ABCDEFGH\0"), ("b", "SECRET_ABCDEFGH" + "x" * 7985 + "\0"), ("c", "SECRET_ABCDEFGH" + "x" * 7984 + "\0")]
    assert [r[0] for r in found(spark, rows)] == ["b"]


def test_generic_findings_give_way_to_specific_ones(spark):
    token = "ghp_" + sha256(b"1").hexdigest()[:36]
    rows = [("x.py", f'my_token = "{token}"\nother_token = "a8Kj2mNx9pQ4rT7v"'), (".env", "DB_PASSWORD=a8Kj2mNx9pQ4rT7v")]
    got = found(spark, rows, ScanOptions(), ("path", "pattern_id"))
    assert got == [(".env", "generic/password-assignment"), ("x.py", "vcs/github-pat"), ("x.py", "generic/token-assignment")]
    every = found(spark, rows, ScanOptions(dedup_generic=False), ("path", "pattern_id"))
    assert len(every) == 4


def test_disabled_and_custom_patterns():
    r = Registry().configured(("ai/groq-api-key", "custom/x"), (Pattern("custom/x", "X", "low", "X", ()),))
    ids = [p.id for p in r.patterns]
    assert "ai/groq-api-key" not in ids and ids[-1] == "custom/x"


def test_patterns_without_keywords_always_run(spark):
    r = Registry((Pattern("custom/n", "N", "low", "[0-9]{5}", ()),))
    assert len(found(spark, [("a", "12345 x 67890")], ScanOptions(r))) == 2


def test_triggers():
    yes = [("api_key", "api_key"), ("MY_API_KEY", "api_key"), ("userPassword", "password"), ("passwordHash", "password"), ("HTTPToken", "token"), ("x.token-y", "token")]
    no = [("tokenizer", "token"), ("mypassword", "password"), ("x", "token"), ("TOKENS", "token"), ("password", "PASSWORD")]
    assert all(is_trigger(n, (w,)) for n, w in yes)
    assert not any(is_trigger(n, (w,)) for n, w in no)


@pytest.mark.parametrize(
    "language, code, names",
    [
        ("python", "a = 'v1'\nb.c = \"v2\"\nd = {'e': 'v3'}\nf(g='v4')\n# h = 'no'\ni = j('no')\nk = 'no' + x\n", ["a", "c", "e", "g"]),
        ("javascript", "const a = 'v1'; b.c = 'v2'; d = \"v3\"; x = {e: 'v4', 'f': 'v5'} // g = 'no'\nh = i('no')", ["a", "c", "d", "e", "f"]),
        ("typescript", "const a: string = 'v1'; let b = 'v2';", ["a", "b"]),
        ("go", 'a := "v1"\nvar b = "v2"\nconst c string = "v3"\nm := map[string]string{"d": "v4"}\ne = `no`', ["a", "b", "c", "d"]),
        ("ruby", "a = 'v1'\n@b = \"v2\"\nf(c: 'v3')\nh = {'d' => 'v4'} # e = 'no'", ["a", "b", "c", "d"]),
        ("java", 'String a = "v1"; this.b = "v2"; /* c = "no" */ int d = f("no");', ["a", "b"]),
        ("rust", 'let a = "v1"; const B: &str = "v2"; static C: &str = "v3"; d.e = "v4"; // f = "no"', ["a", "B", "C", "e"]),
    ],
)
def test_assignments_by_language(language, code, names):
    assert [n for n, _, _ in code_values(code, language)] == names


def test_go_keeps_quotes_and_dotenv_rules():
    assert [v for _, v, _ in code_values('a := "v1"', "go")] == ['"v1"']
    text = "export A=12345678\n B=12345678\nC='12345678'\nD=$VARIABLE\nE=short\nF = 123456789 # x"
    assert list(dotenv_values(text)) == [("C", "12345678", text.index("C='") + 3), ("F", "123456789", text.index("F = ") + 4)]


@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_entropy_equals_its_definition(spark, texts):
    import math
    from collections import Counter

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.entropy(F.col("t"))).orderBy("i").collect()
    for (_, g), t in zip(got, texts, strict=True):
        b = t.encode()
        want = -sum(c / len(b) * math.log2(c / len(b)) for c in Counter(b).values())
        assert abs(g - want) < 1e-9


def test_text_functions(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    s = F.lit
    assert one(tx.mask(s("a" * 24))) == "aaaa" + tx.BULLETS + "aaaa" and one(tx.mask(s("short"))) == tx.BULLETS
    assert one(tx.normalise_path(s("././a\\b"))) == "a/b"
    assert [one(tx.is_dotenv(s(p))) for p in (".env", "a/.env.local", ".envrc", "config.env")] == [True, True, False, False]
    assert [one(tx.language(s(p))) for p in ("a.py", "a.PY", "b.tsx", "py")] == ["python", None, "typescript", None]
    assert one(tx.comment_ignore(s("a.html"))) == f"<!-- {tx.IGNORE_MARKER} -->" and one(tx.comment_ignore(s("a.unknown"))) is None
    assert one(tx.env_name(s("vcs/github-pat"))) == "GITHUB_PAT"
    assert [one(tx.strip_quotes(s(x))) for x in ("'a'", '"a', "`a`", "''")] == ["a", '"a', "a", ""]
    assert one(tx.truncate(s("abcdef"), 4)) == "abc…" and one(tx.pluralise(s(2), "file")) == "2 files"
    assert one(tx.file_size(s(2048))) == "2KB" and one(tx.duration(s(61.5))) == "1m 1s"
    assert one(tx.has_binary_extension(s("a/B.PNG"))) and not one(tx.has_binary_extension(s(".png")))


@given(st.text(min_size=1, max_size=60))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_masks_hide(spark, s):
    m = spark.createDataFrame([(s,)], "s string").select(tx.mask(F.col("s"))).first()[0]
    assert m and (len(s) < 24 or s not in m)


def test_spans_give_the_secret_and_ids_depend_on_pattern_and_secret(spark):
    text = "é\n🙂 SECRET_ABCDEFGH\n"
    files = spark.createDataFrame([("a", text), ("b", "SECRET_ABCDEFGH")], "path string, content string")
    rows = raw_findings(files, ScanOptions(SECRET)).orderBy("path").collect()
    assert text.encode()[rows[0].byte_start : rows[0].byte_end].decode() == rows[0].secret
    assert rows[0].id == rows[1].id and rows[0].fingerprint != rows[1].fingerprint
    assert "secret" not in scan(files, ScanOptions(SECRET)).columns


def test_context_lines_mask(spark):
    files = spark.createDataFrame([("a", "x\nSECRET_ABCDEFGH\ny\nz")], "path string, content string")
    rows = context_lines(files, ScanOptions(SECRET)).orderBy("number").collect()
    assert [(r.number, r.text, r.is_finding) for r in rows] == [(1, "x", False), (2, "SE••••••••GH", True), (3, "y", False)]


def test_empty_table(spark):
    assert found(spark, []) == []
    assert ascii_lower("ÄB") == "Äb"
