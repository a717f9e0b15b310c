"""Reports: JSON, SARIF, text, counts, and lists of patterns."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import GROUPS, Registry
from ..functions import text as tx

TOOL = "hushgrid"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def scan_json(findings: DataFrame, verification: DataFrame | None = None) -> DataFrame:
    """(path, byte_start, json): an object a finding; what isn't known is left out."""
    rows = findings if verification is None else findings.join(verification.select("id", F.struct("status", "provider", "metadata", "verified_at").alias("verification")), "id", "left")
    fields = ["id", "path", "line", "column", "pattern_id", "severity", "confidence", "secret_masked", "fingerprint"] + (["verification"] if verification is not None else [])
    return rows.select("path", "byte_start", F.to_json(F.struct(*fields)).alias("json"))


def _rules(patterns: DataFrame) -> DataFrame:
    rule = F.struct(F.col("pattern_id").alias("id"), "name", F.struct(F.col("description").alias("text")).alias("shortDescription"), F.struct(tx.sarif_level(F.col("severity")).alias("level")).alias("defaultConfiguration"))
    return patterns.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.to_json(rule).alias("rule")))), lambda r: r["rule"]), ",").alias("rules"))


def _lines(head: DataFrame, results: DataFrame, tail: str) -> DataFrame:
    """(part, at, n, text) of a document: its head, one line a result (at, n, text), its end. Nothing is gathered: ``document`` puts them together."""
    ends = lambda part, text: (F.lit(part).alias("part"), F.lit("").alias("at"), F.lit(0).cast("long").alias("n"), text.alias("text"))
    return head.select(*ends(0, F.col("text"))).unionAll(results.select(F.lit(1).alias("part"), "at", F.col("n").cast("long").alias("n"), "text")).unionAll(results.sparkSession.range(1).select(*ends(2, F.lit(tail))))


def pieces(lines: DataFrame) -> Iterator[str]:
    """The text of a document of lines, piece by piece, in order."""
    last = 0
    for r in lines.orderBy("part", "at", "n", "text").toLocalIterator():
        yield (",\n" if r.part == last == 1 else "") + r.text
        last = r.part


def document(lines: DataFrame) -> str:
    return "".join(pieces(lines))


def _sarif(results: DataFrame, patterns: DataFrame) -> DataFrame:
    start = '{"$schema":"' + SARIF_SCHEMA + '","version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + TOOL + '","rules":['
    return _lines(_rules(patterns).select(F.concat(F.lit(start), "rules", F.lit(']}},"results":[')).alias("text")), results, "]}]}")


def _location(path: Column, line: Column, column: Column) -> Column:
    region = F.struct(line.alias("startLine"), column.alias("startColumn"))
    return F.array(F.struct(F.struct(F.struct(path.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))


def scan_sarif(findings: DataFrame, registry: Registry | None = None) -> DataFrame:
    """A SARIF log as lines, with all loaded patterns as rules."""
    result = F.struct(
        F.col("pattern_id").alias("ruleId"), tx.sarif_level(F.col("severity")).alias("level"), F.struct(F.concat("pattern_id", F.lit(": "), "secret_masked").alias("text")).alias("message"),
        _location(F.col("path"), F.col("line"), F.col("column")).alias("locations"), F.struct(F.col("fingerprint").alias("secret/v1")).alias("fingerprints"),
    )
    return _sarif(findings.select(F.col("path").alias("at"), F.col("byte_start").alias("n"), F.to_json(result).alias("text")), (registry or Registry()).table(findings.sparkSession))


COMMIT = ("hash", "short_hash", "author_name", "author_email", "message")


def _iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _commit(x: Column, fields: list[str]) -> Column:
    """What is known of a commit, of those fields that a place has."""
    return F.struct(*[x[c].alias(c) for c in COMMIT if c in fields], _iso(x["date"]).alias("date"))


def _place_fields(found: DataFrame) -> list[str]:
    return found.schema["introduced"].dataType.names


def history_sarif(found: DataFrame, registry: Registry | None = None) -> DataFrame:
    """The same for a history; rules are the patterns that have findings, each result is where and in what commit its secret came in."""
    patterns = (registry or Registry()).table(found.sparkSession).join(found.select("pattern_id").distinct(), "pattern_id", "left_semi")
    x = F.col("introduced")
    about = F.struct(F.lit("history").alias("scan_type"), _commit(x, _place_fields(found)).alias("commit"), F.col("occurrence_count").alias("occurrence_count"))
    result = F.struct(
        F.col("pattern_id").alias("ruleId"), tx.sarif_level(F.col("severity")).alias("level"), F.struct(F.concat("pattern_id", F.lit(" in the history")).alias("text")).alias("message"),
        _location(x["path"], x["line"], x["column"]).alias("locations"), F.struct(F.col("id").alias("secret/v1")).alias("fingerprints"), about.alias("properties"),
    )
    return _sarif(found.select(F.concat(_iso(x["date"]), F.lit(" "), "pattern_id").alias("at"), F.lit(0).alias("n"), F.to_json(result).alias("text")), patterns)


def history_json(found: DataFrame, metadata: dict[str, int] | None = None) -> DataFrame:
    """A document as lines: version, metadata if given, counts by severity, and the findings by date of introduction, with their occurrences if
    they were kept."""
    fields = _place_fields(found)
    seen = lambda x: F.struct(_commit(x, fields).alias("commit"), F.struct(*[x[c].alias(c) for c in ("path", "line", "column")]).alias("location"), x["masked_line"].alias("line_content"))
    kept = [F.transform("occurrences", seen).alias("occurrences")] if "occurrences" in found.columns else []
    item = F.struct("id", "pattern_id", "severity", "confidence", "secret_masked", seen(F.col("introduced")).alias("introduced_in"), *kept, "occurrence_count")
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")]
    one = found.agg(F.count("*").alias("secrets_found"), F.coalesce(F.sum("occurrence_count"), F.lit(0)).alias("total_occurrences"), *counts)
    summary = F.to_json(F.struct("secrets_found", "total_occurrences", F.struct("critical", "high", "medium", "low").alias("by_severity")))
    about = f'"metadata":{json.dumps(metadata)},' if metadata else ""
    head = one.select(F.concat(F.lit('{"version":"1.0","scan_type":"history",' + about + '"summary":'), summary, F.lit(',"findings":[')).alias("text"))
    return _lines(head, found.select(F.concat(_iso(F.col("introduced_at")), F.lit(" "), "pattern_id").alias("at"), F.lit(0).alias("n"), F.to_json(item).alias("text")), "]}")


def history_text(found: DataFrame) -> DataFrame:
    """(introduced_at, pattern_id, id, text): a block a secret; with its occurrences kept, a tree of its commits, adjacent ones of one commit once."""
    fields, x = _place_fields(found), F.col("introduced")
    short = lambda x: x["short_hash"] if "short_hash" in fields else F.substring(x["hash"], 1, 7)
    day = lambda x: F.date_format(x["date"], "yyyy-MM-dd")
    head = F.concat(F.upper("severity"), F.lit(" "), "pattern_id")
    if "occurrences" not in found.columns:
        said = F.concat(F.lit("\n  "), short(x), *([F.lit(" "), tx.truncate(x["message"], 50)] if "message" in fields else []), F.lit("\n  "), day(x), *([F.lit(" · "), x["author_email"]] if "author_email" in fields else []))
        text = F.concat(head, F.lit(" · "), tx.pluralise(F.col("occurrence_count"), "time"), said, F.lit("\n  └─ "), x["path"], F.lit(":"), x["line"].cast("string"), F.lit("\n     "), x["masked_line"])
    else:
        once = F.filter("occurrences", lambda o, i: (i == 0) | (o["hash"] != F.get("occurrences", i - 1)["hash"]))
        branch = lambda every: F.transform(every, lambda o, i: F.concat(F.when(i == F.size(every) - 1, "  └─ ").otherwise("  ├─ "), short(o), F.lit(" "), o["path"], F.lit(":"), o["line"].cast("string"), F.lit(" · "), day(o), F.when(o["hash"] == x["hash"], " (introduced)").otherwise("")))
        tree = F.array_join(F.transform(F.array(once), branch)[0], "\n")
        text = F.concat(head, F.lit(" · "), tx.pluralise(F.col("occurrence_count"), "occurrence"), F.lit("\n  "), x["masked_line"], F.lit("\n"), tree)
    return found.select("introduced_at", "pattern_id", "id", text.alias("text"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def confidence_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("pattern_id", "severity", "confidence").agg(F.count("*").alias("n"))


def text_lines(findings: DataFrame, context: DataFrame | None = None, verification: DataFrame | None = None) -> DataFrame:
    """(path, byte_start, text): a block of text a finding, with an underline and advice; with the lines around it if ``context`` (of
    ``context_lines``) is given, and what its verification says. Of n findings of a file, which one it is."""
    group = F.substring_index("pattern_id", "/", 1)
    advice = None
    for k, (_, r) in GROUPS.items():
        advice = F.when(group == k, r) if advice is None else advice.when(group == k, r)
    gutter = lambda n: F.lpad(n.cast("string"), 5, " ")
    under = F.concat(F.repeat(F.lit(" "), F.col("column") + 7), F.repeat(F.lit("^"), F.char_length("secret_masked")))
    place = Window.partitionBy("path")
    of = F.when(F.col("_of") > 1, F.format_string(" [%d of %d]", F.col("_i"), F.col("_of"))).otherwise("")
    head = F.concat(F.upper("severity"), F.lit(" "), "pattern_id", F.lit(" at "), "path", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"), F.when(F.col("confidence") == "low", " (low confidence)").otherwise(""), of)
    rows = findings.withColumns({"_i": F.row_number().over(place.orderBy("byte_start", "pattern_id", "byte_end")), "_of": F.count("*").over(place)})
    frame = F.concat(gutter(F.col("line")), F.lit(" | "), "masked_line", F.lit("\n"), under)
    if context is not None:
        lines = context.groupBy("id", "path", "byte_start").agg(F.sort_array(F.collect_list(F.struct("number", "text"))).alias("_lines"))  # 2 * around + 1 of them
        shown = lambda keep: F.array_join(F.transform(F.filter("_lines", keep), lambda x: F.concat(gutter(x["number"]), F.lit(" | "), x["text"])), "\n")
        rows = rows.join(lines, ["id", "path", "byte_start"], "left")
        above, below = shown(lambda x: x["number"] < F.col("line")), shown(lambda x: x["number"] > F.col("line"))
        frame = F.concat(F.when(above != "", F.concat(above, F.lit("\n"))).otherwise(""), frame, F.when(below != "", F.concat(F.lit("\n"), below)).otherwise(""))
    said = F.lit("")
    if verification is not None:
        rows = rows.join(verification.select("id", F.col("status").alias("_status"), F.col("provider").alias("_provider"), F.col("metadata").alias("_metadata")), "id", "left")
        about = F.concat_ws(", ", F.transform("_metadata", lambda m: F.concat(m["label"], F.lit(": "), m["value"])))
        said = F.when(F.col("_status").isNotNull(), F.concat(F.lit("\n"), "_status", F.lit(" · "), F.coalesce("_provider", F.lit("?")), F.when(about != "", F.concat(F.lit(" · "), about)).otherwise(""))).otherwise("")
    return rows.select("path", "byte_start", F.concat(head, F.lit("\n"), frame, said, F.lit("\n"), F.coalesce(advice, F.lit(GROUPS["custom"][1]))).alias("text"))


def pattern_list(patterns: DataFrame, group: str | None = None, severity: str | None = None) -> DataFrame:
    """Patterns of a group (whatever its case) and of exactly a severity."""
    out = patterns
    if group:
        out = out.where(F.lower("group") == group.lower())
    if severity:
        out = out.where(F.col("severity") == severity.lower())
    return out


def pattern_rollup(patterns: DataFrame) -> DataFrame:
    """Patterns by severity and group, with subtotals and the total."""
    return patterns.rollup("severity", "group").agg(F.count("*").alias("n"))


def by_file(findings: DataFrame) -> DataFrame:
    """A row a file: its findings in order."""
    item = F.struct("byte_start", "line", "column", "pattern_id", "severity", "confidence", "id")
    return findings.groupBy("path").agg(F.sort_array(F.collect_list(item)).alias("findings"))


def exit_code(findings: DataFrame, exit_zero: bool = False, allow_new: bool = False) -> int:
    """1 if a finding of high confidence is left, else 0."""
    return int(not (exit_zero or allow_new) and bool(findings.where("confidence = 'high'").head(1)))
