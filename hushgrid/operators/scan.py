"""The scan: files (path, content) to findings.

Plan: a narrow prefilter (one trie-shaped regex over the lower-cased text) names the candidate patterns of each file; their regexes are
matched, and the matches placed, marked and deduplicated within the file's row, as arrays. Then the matches are exploded, without the
text. Nothing is shuffled or joined but the few facts of the patterns. Only assignments in source code and dotenv files, for the files that
have a trigger word, go through Arrow.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import GENERIC, Registry, literal_first
from ..functions import text as tx
from ..functions.text import bound
from .assignments import assigned

FINDING = ("id", "path", "line", "column", "byte_start", "byte_end", "pattern_id", "severity", "confidence", "masked_line", "secret_masked", "secret_hash", "fingerprint")


@dataclass(frozen=True)
class ScanOptions:
    registry: Registry = field(default_factory=Registry)
    severity: str = "low"
    marker: str = tx.IGNORE_MARKER
    #: Which strategies run.
    regexes: bool = True
    assignments: bool = True
    dedup_generic: bool = True


def prefilter(files: DataFrame, registry: Registry) -> DataFrame:
    """The rows with the distinct keywords (lower case) that the leftmost-longest, non-overlapping search finds; null for a null text.

    RE2 runs the trie as one automaton, in time linear in the text, whatever the number of keywords; the JVM's engine would try alternative
    after alternative at every character. RE2 gives the texts between the hits; at each of their ends, the trie says which keyword stands there."""
    search, always = registry.search(), [w for w in registry.keywords() if not w]

    @F.arrow_udf("array<string>")
    def hits(contents: pa.Array) -> pa.Array:
        at_hit = re.compile(search.encode())

        def words(text: bytes, gaps: list[int]) -> dict[str, None]:
            got, at = {}, 0
            for gap in gaps[:-1]:
                at += gap
                end = at_hit.match(text, at).end()
                got[text[at:end].decode().translate(lower)] = None
                at = end
            return got

        lower = {c: c + 32 for c in range(65, 91)}
        raw = contents.cast(pa.binary()) if pa.types.is_string(contents.type) else contents.cast(pa.large_binary())
        if not search:
            return pa.array([None if not t.is_valid else always for t in raw], pa.list_(pa.string()))
        try:
            some = pc.fill_null(pc.match_substring_regex(contents, search), False)
            which = pc.indices_nonzero(some)
            gaps = pc.split_pattern_regex(contents.take(which), search)
            sizes = pc.binary_length(gaps.flatten()).to_pylist()
            ends = pc.cumulative_sum(pc.list_value_length(gaps)).to_pylist()
            got = {i: list(words(raw[i].as_py(), sizes[a:b])) for i, a, b in zip(which.to_pylist(), [0, *ends], ends)}
        except pa.ArrowInvalid:  # more keywords than RE2 takes
            got = {i: list(dict.fromkeys(m.decode().translate(lower) for m in at_hit.findall(t.as_py()))) for i, t in enumerate(raw) if t.is_valid}
        return pa.array([None if not t.is_valid else got.get(i, []) + always for i, t in enumerate(raw)], pa.list_(pa.string()))

    return files.withColumn("hits", hits(F.col("content")))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _candidates(hits: Column, registry: Registry, wanted: list[int]) -> Column:
    """Ordinals of the wanted patterns that a hit selects, and of those without keywords."""
    keep = set(wanted)
    pairs = [f"{_quoted(w)}, array({', '.join(map(str, ok))})" for w, ids in sorted(registry.keywords().items()) if (ok := [i for i in ids if i in keep])]
    always = [i for i in wanted if not registry.patterns[i].keywords]
    known, none = F.expr(f"map({', '.join(pairs)})"), F.expr("cast(array() as array<int>)")  # as text: one call to the JVM
    found = F.flatten(F.transform(hits, lambda h: F.coalesce(known[h], none))) if pairs else none
    return F.array_distinct(F.concat(found, F.array(*map(F.lit, always)).cast("array<int>"))) if always else F.array_distinct(found)


def _matches(registry: Registry, candidates: Column) -> Column:
    """Every leftmost non-overlapping match of the candidates: array of (ordinal, secret, value, chars), with the characters before it.

    The regexes come from a constant array, so the plan doesn't grow with the files; the engine compiles one once a candidate, which is
    little beside matching it over a text."""
    rx = F.expr(f"array({', '.join(_quoted(literal_first(p.regex)) for p in registry.patterns)})")
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)
    content = F.col("content")

    def placed(x: Column, t: Column, chars: Column) -> Column:
        return F.struct(x["ordinal"].alias("ordinal"), t.alias("secret"), t.alias("value"), chars.cast("int").alias("chars"))

    def by_gaps(x: Column) -> Column:
        sizes = F.struct(F.transform(F.split(content, rx[x["ordinal"]], -1), F.char_length).alias("gaps"), F.transform(x["m"], F.char_length).alias("own"))
        at = lambda g, i: total(F.slice(g["gaps"], F.lit(1), i + 1)) + total(F.slice(g["own"], F.lit(1), i))
        return bound(sizes, lambda g: F.transform(x["m"], lambda t, i: placed(x, t, at(g, i))))

    def places(x: Column) -> Column:
        """A few matches whose texts stand only once in the content are looked up; for others the regex parts the content once more."""
        once = lambda t: F.call_function("locate", t, content, F.instr(content, t) + 1) == 0
        return F.when((F.size(x["m"]) <= 4) & F.forall(x["m"], once), F.transform(x["m"], lambda t: placed(x, t, F.instr(content, t) - 1))).otherwise(by_gaps(x))

    hit = F.filter(F.transform(candidates, lambda o: F.struct(o.alias("ordinal"), F.regexp_extract_all(content, rx[o], F.lit(0)).alias("m"))), lambda x: F.size(x["m"]) > 0)
    return F.flatten(F.transform(hit, places))


def _without_generic(found: Column, generic: list[int]) -> Column:
    """Without the generic matches that overlap a specific one; generic ones don't dedup each other."""
    is_generic = lambda x: x["ordinal"].isin(*generic) if generic else F.lit(False)
    end = lambda x: x["chars"] + F.char_length(x["secret"])
    over = lambda x, y: ~is_generic(y) & (x["chars"] < end(y)) & (y["chars"] < end(x))
    return bound(found, lambda every: F.filter(every, lambda x: ~is_generic(x) | ~F.exists(every, lambda y: over(x, y))))


def _placed(x: Column, around: int) -> Column:
    """A match with its place: bytes and line, what stands before and after it on its line, and so many lines above and below."""
    content = F.col("content")
    both = F.struct(F.substring(content, F.lit(1), x["chars"]).alias("before"), F.substring(content, x["chars"] + F.char_length(x["secret"]) + 1, F.lit(1 << 30)).alias("after"))
    return bound(
        both,
        lambda t: F.struct(
            *[x[c].alias(c) for c in ("ordinal", "secret", "value", "chars")],
            F.octet_length(t["before"]).cast("long").alias("byte_start"),
            tx.lines(t["before"]).alias("line"),
            F.substring_index(t["before"], "\n", -1).alias("head"),
            F.substring_index(t["after"], "\n", 1).alias("tail"),
            *([F.slice(F.split(F.substring_index(t["before"], "\n", -1 - around), "\n"), 1, around).alias("above"), F.slice(F.split(F.substring_index(t["after"], "\n", 1 + around), "\n"), 2, around).alias("below")] if around else []),
        ),
    )


def nested(files: DataFrame, options: ScanOptions | None = None, around: int = 0) -> DataFrame:
    """(path, content, found) of the text files: ``found`` is the array of the placed matches, without those on a marked line. Every row is
    scanned for itself."""
    o = options or ScanOptions()
    r = o.registry
    runnable = r.runnable(o.severity)
    plain = [i for i in runnable if r.patterns[i].strategy == "regex"] if o.regexes else []
    by_name = [i for i in runnable if r.patterns[i].strategy == "assignment"] if o.assignments else []
    rows = prefilter(files.select("path", "content").where(F.col("content").isNotNull() & ~tx.is_binary(F.col("content"))), r)
    parts = []
    if by_name:
        rows = assigned(rows.withColumn("candidates", _candidates(F.col("hits"), r, by_name)), {i: r.patterns[i].keywords for i in by_name})
        parts.append(F.col("assigned"))
    if plain:
        parts.insert(0, _matches(r, _candidates(F.col("hits"), r, plain)))
    found = F.concat(*parts) if parts else F.expr("cast(array() as array<struct<ordinal:int,secret:string,value:string,chars:int>>)")
    if o.dedup_generic and plain and by_name:
        found = _without_generic(found, [i for i in runnable if r.patterns[i].id.startswith(GENERIC)])
    first_line = lambda x: F.concat(x["head"], F.when(F.instr(x["secret"], "\n") > 0, F.substring_index(x["secret"], "\n", 1)).otherwise(F.concat(x["secret"], x["tail"])))
    kept = F.filter(F.transform(found, lambda x: _placed(x, around)), lambda x: ~F.contains(first_line(x), F.lit(o.marker)))
    return rows.select("path", "content", kept.alias("found"))


def raw_findings(files: DataFrame, options: ScanOptions | None = None, around: int = 0) -> DataFrame:
    """Findings with the secret itself, its entropy and the pattern's ordinal: for operators that need them, never for output."""
    registry = (options or ScanOptions()).registry
    rows = [(i, p.id, p.severity, p.rank, 4.0 if p.strategy == "assignment" else p.min_entropy) for i, p in enumerate(registry.patterns)]
    about = files.sparkSession.createDataFrame(rows, "ordinal int, pattern_id string, severity string, severity_rank int, min_entropy double")
    once = nested(files, options, around).select("path", F.explode(F.array("found")).alias("found"))  # computed once: no filter is inferred from it
    each = once.select("path", F.explode("found").alias("x")).select("path", "x.*").join(F.broadcast(about), "ordinal")
    several = F.instr("secret", "\n") > 0
    hidden, hashed = tx.mask(F.col("secret")), F.sha2("secret", 256)
    return each.select(
        tx.finding_id(F.col("pattern_id"), hashed).alias("id"),
        "path",
        "line",
        (F.char_length("head") + 1).cast("int").alias("column"),
        "byte_start",
        (F.col("byte_start") + F.octet_length("secret")).cast("long").alias("byte_end"),
        "pattern_id",
        "severity",
        tx.confidence(F.col("value"), F.col("min_entropy")).alias("confidence"),
        F.concat("head", hidden, F.when(several, "").otherwise(F.col("tail"))).alias("masked_line"),
        hidden.alias("secret_masked"),
        hashed.alias("secret_hash"),
        tx.fingerprint(F.col("pattern_id"), F.col("path"), hashed).alias("fingerprint"),
        "ordinal",
        "secret",
        F.round(tx.entropy(F.col("value")), 6).alias("entropy"),
        *(["above", "below"] if around else []),
    )


def scan(files: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """Findings of files (path, content): positions, masked texts, identities; no secret leaves the scan.

    Null and binary contents have no finding. Rows with equal paths are scanned each."""
    return raw_findings(files, options).select(*FINDING)


def shared(rows: DataFrame, *by: str) -> DataFrame:
    """The same rows, dealt out by columns: uses of them in one plan read one exchange, so what they come from is computed once. Neither filters
    nor choices of columns get past the row's struct and into the exchange, which would make it another one for each use."""
    whole = rows.select(F.struct(*rows.columns).alias("row")).repartition(*[F.col("row")[c] for c in by])
    return whole.select(F.inline(F.array("row")))


def at_least(findings: DataFrame, minimum: str = "high") -> DataFrame:
    """The findings of at least this confidence."""
    return findings if minimum == "low" else findings.where(F.col("confidence") == "high")


def ordered(findings: DataFrame, registry: Registry | None = None) -> DataFrame:
    """By file and place; of equal places in the order of the registry."""
    place = F.expr("map(" + ", ".join(f"{_quoted(p.id)}, {i}" for i, p in enumerate((registry or Registry()).patterns)) + ")")
    return findings.orderBy("path", "byte_start", place[F.col("pattern_id")], "byte_end")


def context_lines(files: DataFrame, options: ScanOptions | None = None, minimum: str = "low", around: int = 1) -> DataFrame:
    """The lines around each finding, from its own scan: (id, path, byte_start, line, number, text, is_finding). A line with findings is shown with the
    first one's secret masked; only findings are exchanged for that."""
    raw = raw_findings(files, options, around)
    found = at_least(raw, minimum)
    masked = raw.groupBy(F.col("path").alias("m_path"), F.col("line").alias("m_line")).agg(F.min_by("masked_line", F.struct("byte_start", "ordinal")).alias("m_text"))
    numbered = lambda lines, first: F.transform(lines, lambda t, i: F.struct((first + i).cast("int").alias("number"), t.alias("text")))
    every = F.concat(numbered(F.col("above"), F.col("line") - F.size("above")), F.array(F.struct(F.col("line").alias("number"), F.col("masked_line").alias("text"))), numbered(F.col("below"), F.col("line") + 1))
    rows = found.select("id", "path", "byte_start", "line", F.explode(every).alias("x")).select("id", "path", "byte_start", "line", "x.number", "x.text")
    shown = rows.join(masked, (F.col("path") == F.col("m_path")) & (F.col("number") == F.col("m_line")), "left")
    return shown.select("id", "path", "byte_start", "line", "number", F.coalesce("m_text", "text").alias("text"), (F.col("number") == F.col("line")).alias("is_finding"))
