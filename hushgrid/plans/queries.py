"""The queries of the entry point: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import project
from ..catalogue import Registry, groups_table
from ..functions import text as tx
from ..operators import fix as fx
from ..operators import history as hist
from ..operators import report
from ..operators import suppress as sup
from ..operators.scan import FINDING, ScanOptions, at_least, context_lines, prefilter, raw_findings, scan, shared
from ..operators.verify import verification_counts, verify
from ..sources.globs import excluded
from ..streaming import editor
from . import commands
from .corpus import commit_files, files, sample_files, several_files, spread_table, table

NATIVE = ScanOptions(assignments=False)
EXCLUDES = ("*.min.js", "vendor/", "/build/**", "2*.html")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(files(spark, sf_dir), NATIVE)


def half_baseline(findings: DataFrame) -> DataFrame:
    """A baseline of the findings whose fingerprint ends in one of eight digits."""
    known = findings.where(F.substring("fingerprint", -1, 1).isin(*"01234567"))
    r = F.substring("fingerprint", -2, 1)
    base = sup.reviewed(known, "accepted", "reviewed", 1_700_000_000)
    return base.withColumn("status", F.when(r.isin(*"0123"), "ignored").otherwise("accepted")).withColumn("reviewed_at", F.lit(1_700_000_000).cast("long") + F.conv(F.substring("fingerprint", -4, 4), 16, 10).cast("long"))


@query
def keyword_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every keyword hit of documents, pages and conversations."""
    texts = [("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text")]
    parts = [spread_table(spark, sf_dir, t).select(F.lit(t).alias("src"), F.col(i).cast("long").alias("row_id"), F.col(c).alias("content")) for t, i, c in texts]
    every = parts[0].unionAll(parts[1]).unionAll(parts[2])
    once = prefilter(every, Registry()).select("src", "row_id", F.explode(F.array("hits")).alias("hits"))  # no filter is inferred from the search
    return once.select("src", "row_id", F.explode("hits").alias("keyword"))


@query
def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)


@query
def scan_every_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token of every builtin pattern, in documents in turn."""
    return scan(sample_files(spark, sf_dir), NATIVE).select("path", "pattern_id", "severity", "line")


@query
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.confidence_counts(found(spark, sf_dir))


@query
def scan_high_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_least(found(spark, sf_dir)).select("path", "pattern_id", "line", "column", "byte_start", "byte_end")


@query
def scan_severity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.severity_counts(scan(files(spark, sf_dir), ScanOptions(severity="critical", assignments=False)))


@query
def scan_disabled_and_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the classic token pattern, with a custom one in its place."""
    from ..catalogue import Pattern

    r = Registry().configured(("vcs/github-pat",), (Pattern("custom/low", "Own token", "medium", "ghp_a{36}", ("low =",), 1.0),))
    return scan(files(spark, sf_dir), ScanOptions(registry=r, assignments=False)).groupBy("pattern_id", "confidence").agg(F.count("*").alias("n"))


@query
def scan_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_findings(files(spark, sf_dir), NATIVE).select("path", "pattern_id", "byte_start", "entropy")


@query
def scan_with_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patterns, assignments in source code included."""
    return scan(files(spark, sf_dir))


@query
def dotenv_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents read as dotenv files: generic findings before their dedup."""
    env = files(spark, sf_dir).select(F.concat(F.lit("cfg/.env."), F.regexp_extract("path", "([0-9]+)([.][a-z]+)?$", 1)).alias("path"), "content")
    return raw_findings(env, ScanOptions(regexes=False)).select("path", "pattern_id", "byte_start", "byte_end", "line", "secret_hash", "confidence")


@query
def generic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the specific patterns: generic findings that overlap a specific one are gone."""
    env = files(spark, sf_dir).select(F.concat(F.lit("cfg/.env."), F.regexp_extract("path", "([0-9]+)([.][a-z]+)?$", 1)).alias("path"), "content")
    return scan(env).select("path", "pattern_id", "byte_start", "byte_end", "confidence")


@query
def baseline_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = shared(found(spark, sf_dir), "fingerprint")
    return sup.suppress(f, sup.ignore_set(half_baseline(f))).select("fingerprint", "path", "pattern_id", "confidence")


@query
def baseline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return half_baseline(found(spark, sf_dir))


@query
def baseline_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All critical findings, newly ignored, over the baseline."""
    f = shared(found(spark, sf_dir), "fingerprint")
    return sup.upsert(half_baseline(f), sup.reviewed(f.where("severity = 'critical'"), "ignored", "again", 1_800_000_000)).groupBy("status", "reason", "severity").agg(F.count("*").alias("n"))


@query
def baseline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sup.stats(half_baseline(found(spark, sf_dir)))


@query
def baseline_top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sup.top_patterns(half_baseline(found(spark, sf_dir)))


@query
def baseline_review_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sup.review_span(half_baseline(found(spark, sf_dir)))


@query
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = shared(found(spark, sf_dir), "fingerprint")
    return sup.scan_stats(f, sup.ignore_set(half_baseline(f)))


@query
def pattern_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Registry().table(spark).select("ordinal", "pattern_id", "group", "name", "severity", "min_entropy", "verifiable", "strategy", F.array_join("keywords", ",").alias("keywords"))


@query
def pattern_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pattern_rollup(Registry().table(spark))


@query
def pattern_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_table(spark).join(Registry().table(spark).groupBy("group").agg(F.count("*").alias("n")), "group", "left").select("group", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query
def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).rollup("severity", "pattern_id").agg(F.count("*").alias("n"))


@query
def findings_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of labelled documents by their labels."""
    f = found(spark, sf_dir).select(F.regexp_extract("path", r"([0-9]+)(\.[a-z]+)?$", 1).cast("long").alias("doc_id"), "confidence")
    return f.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic", "confidence").agg(F.count("*").alias("n"))


@query
def findings_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_file(found(spark, sf_dir)).select("path", F.size("findings").alias("n"), F.to_json("findings").alias("findings"))


@query
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scan_json(found(spark, sf_dir))


@query
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.text_lines(found(spark, sf_dir))


@query
def report_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scan_sarif(found(spark, sf_dir))


@query
def history_introductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, b = commit_files(spark, sf_dir)
    return hist.first_introductions(hist.occurrences(c, b, NATIVE)).drop("masked_line", "path", "secret_masked", "introduced")


@query
def history_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, b = commit_files(spark, sf_dir)
    return hist.changed_files(b.select("hash", "path", F.sha2("content", 256).alias("blob")), c.select("hash", "parent"))


@query
def history_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an index; those with an even id, as they were before the planted line, as the head."""
    f = files(spark, sf_dir).where("content is not null")
    head = f.select("path", F.when(F.substring(F.sha2("path", 256), 1, 1).isin(*"01234567"), F.sha2("content", 256)).otherwise(F.sha2(F.lit("old"), 256)).alias("blob"))
    return hist.staged(f.select("path", F.sha2("content", 256).alias("blob")), head)


@query
def history_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 commits until a day."""
    return hist.walk(commit_files(spark, sf_dir)[0], 100, until="2023-11-14").select("hash", "date")


@query
def history_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, b = commit_files(spark, sf_dir)
    return hist.adjacent_once(hist.occurrences(c, b, NATIVE)).groupBy("pattern_id").agg(F.count("*").alias("n"))


@query
def history_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, b = commit_files(spark, sf_dir)
    return report.history_json(hist.first_introductions(hist.occurrences(c, b, NATIVE), keep_all=True))


@query
def history_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of a history with the commits that they are in."""
    c, b = commit_files(spark, sf_dir)
    return report.history_text(hist.first_introductions(hist.occurrences(c, b, NATIVE), keep_all=True)).select("pattern_id", "id", "text")


@query
def history_report_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, b = commit_files(spark, sf_dir)
    return report.history_sarif(hist.first_introductions(hist.occurrences(c, b, NATIVE)))


def _fixed(action: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fx.fixed(several_files(spark, sf_dir), action, NATIVE).select("path", F.sha2("content", 256).alias("sha"), "n_edits")

    return run


for _action in fx.ACTIONS:
    QUERIES[f"fix_{_action}"] = _fixed(_action)


@query
def finding_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_lines(files(spark, sf_dir), NATIVE).select("path", "number", "text", "is_finding")


@query
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.repeated_lines(found(spark, sf_dir).unionByName(found(spark, sf_dir)))


@query
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits of a user's buffer, quiet for an hour."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("uri"), F.col("props").alias("content"), "ts")
    return editor.debounced(e.where("ts is not null"), "1 hour")


@query
def verification_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as requests and purchases as verifications of a user, valid for an hour."""
    e = table(spark, sf_dir, "events").where("ts is not null")
    ask = e.where("event_type = 'click'").select(F.col("user_id").alias("id"), "ts").distinct()
    known = e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("id"), "ts").agg(F.max("props").alias("status"))
    return editor.fresh_verifications(ask, known, 3600)


@query
def editor_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editor.diagnostics(found(spark, sf_dir), names=Registry().table(spark)).drop("finding_id")


@query
def editor_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = editor.diagnostics(found(spark, sf_dir), names=Registry().table(spark))
    return editor.code_actions(d).groupBy("title").agg(F.count("*").alias("n"))


@query
def editor_hover(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Registry().table(spark)
    d = editor.diagnostics(shared(found(spark, sf_dir), "fingerprint"), names=r)
    return editor.hover(d.dropDuplicates(["finding_id"]), r, d.select("finding_id", (F.substring("finding_id", 1, 1) < "8").alias("in_head")).distinct())


@query
def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a stand-in that finds secrets live or inactive by their hash; no network."""
    from hashlib import sha256

    stub = lambda s: (200 if sha256(s.encode()).hexdigest()[0] < "8" else 401, [])
    raw = shared(raw_findings(files(spark, sf_dir), NATIVE).select("id", "pattern_id", "secret", "fingerprint"), "fingerprint")
    return verification_counts(raw, verify(raw, {"GitHub": stub, "Stripe": stub}, "2024-01-01T00:00:00Z"))


@query
def key_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_findings(files(spark, sf_dir), NATIVE)
    return raw.groupBy("pattern_id", tx.key_type(F.col("pattern_id"), F.col("secret")).alias("key_type")).agg(F.count("*").alias("n"))


@query
def file_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: whether their name is excluded or binary, their text binary or too large."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), r"\?.*$", "")
    name = F.concat(path, F.when(F.pmod("page_id", F.lit(3)) == 0, ".PNG").when(F.pmod("page_id", F.lit(3)) == 1, ".html").otherwise(".min.js"))
    p = table(spark, sf_dir, "pages").select("page_id", name.alias("path"), "html")
    return p.select("page_id", "path", excluded(F.col("path"), EXCLUDES).alias("is_excluded"), tx.has_binary_extension(F.col("path")).alias("binary_name"), tx.is_binary(F.col("html")).alias("binary_text"), (F.octet_length("html") > 4096).alias("too_large"))


@query
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = files(spark, sf_dir)
    p, c = F.col("path"), F.col("content")
    line = F.substring_index(c, "\n", -1)
    return d.select(
        "path",
        F.round(tx.entropy(line), 6).alias("line_entropy"),
        tx.mask(line).alias("masked"),
        tx.normalise_path(F.concat(F.lit(".\\./"), p)).alias("normal_path"),
        tx.language(p).alias("language"),
        tx.is_dotenv(p).alias("dotenv"),
        tx.comment_ignore(p).alias("comment"),
        tx.env_name(F.concat(F.lit("a/"), p, F.lit("-key"))).alias("env_name"),
        tx.strip_quotes(F.regexp_extract(line, '"[^"]*"', 0)).alias("unquoted"),
        tx.truncate(line, 12).alias("short"),
        tx.pluralise(F.char_length(line) % 3, "line").alias("plural"),
        tx.file_size(F.octet_length(c) * 100).alias("file_size"),
        tx.duration(F.octet_length(c) / 64.0).alias("duration"),
    )


@query
def project_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of a source each, with marker files by id."""
    d = table(spark, sf_dir, "documents")
    k = F.pmod("doc_id", F.lit(40))
    name = F.when(k == 0, "Cargo.toml").when(k == 11, "package.json").when(k == 22, "go.mod").when(k == 33, "pom.xml").otherwise("x.py")
    out = project.projects(d.where("source is not null").select(F.concat("source", F.lit("/"), name).alias("path")))
    return out.select("root", F.array_join("kinds", ",").alias("kinds"), F.array_join("excludes", ",").alias("excludes"))


FLAGSHIP = scan_summary
assert set(FINDING)  # the columns that scan_findings has
