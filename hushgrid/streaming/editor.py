"""The editor service over a stream of edits (uri, content, ts, kind).

Every function but the sinks works on a batch and on a stream alike. A session of a uri ends when it is quiet for more than the gap; its last
content is scanned. Kinds: ``open`` and ``change`` are scanned, ``save`` isn't, ``close`` clears the diagnostics of its uri.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.scan import ScanOptions, at_least, scan
from ..sources.globs import excluded
from ..sources.globs import ignored as ignored_by

GAP = "300 milliseconds"
LATENESS = "10 seconds"
VERIFICATION_TTL_S = 300
IN_FLIGHT_S = 60
#: Verifications that are remembered.
CACHED = 512


def debounced(edits: DataFrame, gap: str = GAP, lateness: str = LATENESS, key: str = "uri", content: str = "content", ts: str = "ts") -> DataFrame:
    """(key, content, ts, n_edits): the last content of each session, ties by the greater content. Edits later than ``lateness`` are dropped
    in a stream."""
    marked = edits.withWatermark(ts, lateness) if edits.isStreaming else edits
    last = F.max(F.struct(F.col(ts).alias("ts"), F.col(content).alias("content"))).alias("last")
    out = marked.groupBy(key, F.session_window(ts, gap).alias("w")).agg(last, F.count("*").alias("n_edits"))
    return out.select(key, F.col("last.content").alias("content"), F.col("last.ts").alias("ts"), "n_edits")


def to_scan(edits: DataFrame) -> DataFrame:
    """The edits that ask for a scan."""
    return edits.where(F.col("kind").isin("open", "change"))


def open_buffers(edits: DataFrame) -> DataFrame:
    """(uri, content, ts) of the buffers that aren't closed, as they are last; a save has no content of its own."""
    last = edits.where("kind <> 'save'").groupBy("uri").agg(F.max_by(F.struct("kind", "content", "ts"), F.struct("ts", "content")).alias("x"))
    return last.where("x.kind <> 'close'").select("uri", "x.content", "x.ts")


def rescans(edits: DataFrame, changes: DataFrame) -> DataFrame:
    """Edits that a change of the configuration (ts) makes: every buffer that is open then is scanned again as it is. Changes are few: they are
    broadcast."""
    at = changes.select(F.col("ts").alias("changed"))
    then = edits.where("kind <> 'save'").join(F.broadcast(at), F.col("ts") <= F.col("changed"))
    last = then.groupBy("uri", "changed").agg(F.max_by(F.struct("kind", "content"), F.struct("ts", "content")).alias("x"))
    return last.where("x.kind <> 'close'").select("uri", "x.content", F.col("changed").alias("ts"), F.lit("change").alias("kind"))


def states(edits: DataFrame, root: str = "", excludes: tuple[str, ...] = (), ignore_files: Iterable[tuple[str, Iterable[str]]] = ()) -> DataFrame:
    """(uri, content, ts) for ``debounced`` and ``publish``: the contents to scan; null, which clears, where a buffer is closed and for files outside the
    workspace, excluded, or ignored by the workspace's ignore files (folder, lines). Saves have no state."""
    rows = edits.where("kind <> 'save'")
    if root or excludes:
        inner = F.substring(F.col("uri"), F.lit(len(root.rstrip("/")) + 2), F.lit(1 << 30))
        rows = in_workspace(rows, root, excludes, ignored_by(inner, ignore_files))
    else:
        rows = rows.withColumn("watched", F.lit(True))
    return rows.select("uri", F.when((F.col("kind") != "close") & F.col("watched"), F.col("content")).alias("content"), "ts")


def minimum_of(editor_setting: str | None, configured: str | None) -> str:
    """The least confidence shown: the editor's setting, else the configuration's, else high."""
    return editor_setting or configured or "high"


def newest(verified: DataFrame, most: int = CACHED) -> DataFrame:
    """The cache's bound: the verifications (id, ts) of the ``most`` ids that were verified last."""
    last = verified.groupBy("id").agg(F.max("ts").alias("_last")).orderBy(F.desc("_last"), "id").limit(most)
    return verified.join(F.broadcast(last.select("id")), "id", "left_semi")


def in_workspace(edits: DataFrame, root: str, excludes: tuple[str, ...] = (), ignored: Column | None = None) -> DataFrame:
    """With ``watched``: false outside the workspace and for excluded or ignored files, whose diagnostics are cleared."""
    inside = F.col("uri").startswith(root.rstrip("/") + "/")
    out = inside & ~excluded(F.col("uri"), excludes, "editor", root)
    return edits.withColumn("watched", out if ignored is None else out & ~ignored)


def scanned(states: DataFrame, options: ScanOptions | None = None, minimum: str = "high", ignored: DataFrame | None = None) -> DataFrame:
    """Findings of (uri, content), confidence first, then the ignore set (fingerprints)."""
    found = at_least(scan(states.select(F.col("uri").alias("path"), "content"), options), minimum)
    return found if ignored is None else found.join(ignored, "fingerprint", "left_anti").select(*found.columns)


def diagnostics(findings: DataFrame, verification: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """A diagnostic a finding: 0-based range (its end is the start column and the bytes of the secret), severity, message, tag.

    A live secret is an error, an inactive one a warning; low confidence is tagged as unnecessary."""
    rows = findings
    if verification is not None:
        rows = rows.join(verification.select("id", "status", "provider"), "id", "left")
    else:
        rows = rows.withColumns({"status": F.lit(None).cast("string"), "provider": F.lit(None).cast("string")})
    rows = rows.join(F.broadcast(names.select("pattern_id", "name", "verifiable")), "pattern_id", "left") if names is not None else rows.withColumns({"name": F.col("pattern_id"), "verifiable": F.lit(False)})
    said = F.when(F.col("status") == "live", F.concat(F.lit("Live: "), "name")).when(F.col("status") == "inactive", F.concat(F.lit("Inactive: "), "name")).otherwise(F.concat("name", F.lit(" found")))
    level = F.when(F.col("status") == "live", "ERROR").when(F.col("status") == "inactive", "WARNING").otherwise(tx.editor_severity(F.col("severity")))
    return rows.select(
        F.col("path").alias("uri"),
        (F.col("line") - 1).alias("start_line"),
        (F.col("column") - 1).alias("start_character"),
        (F.col("line") - 1).alias("end_line"),
        (F.col("column") - 1 + F.col("byte_end") - F.col("byte_start")).cast("int").alias("end_character"),
        level.alias("severity"),
        said.alias("message"),
        F.when(F.col("confidence") == "low", "unnecessary").alias("tag"),
        F.to_json(F.struct("fingerprint", F.col("id").alias("finding_id"), "verifiable", F.col("status").alias("verification"))).alias("data"),
        "pattern_id",
        F.col("id").alias("finding_id"),
        "fingerprint",
    )


def code_actions(found: DataFrame, marker: str = tx.IGNORE_MARKER) -> DataFrame:
    """What can be done about each diagnostic: (uri, start_line, finding_id, title, edit)."""
    line = F.concat(F.lit(" "), tx.comment_ignore(F.col("uri"), marker))
    verifiable = F.get_json_object("data", "$.verifiable") == "true"
    act = lambda title, edit, when=F.lit(True): F.when(when, F.struct(F.lit(title).alias("title"), edit.cast("string").alias("edit")))
    each = F.array_compact(F.array(act("Ignore on this line", line, line.isNotNull()), act("Ignore in the configuration", F.col("fingerprint")), act("Verify", F.col("finding_id"), verifiable), act("Ignore all on this line", line, line.isNotNull() & (F.col("on_line") > 1))))
    per_line = found.where("uri is not null and start_line is not null").withColumn("on_line", F.count("*").over(Window.partitionBy("uri", "start_line")))
    return per_line.select("uri", "start_line", "finding_id", F.explode(each).alias("a")).select("uri", "start_line", "finding_id", "a.title", "a.edit")


def at_position(found: DataFrame, positions: DataFrame) -> DataFrame:
    """The first diagnostic under each position (uri, line, character): a point in a closed range, the leftmost one wins."""
    p = positions.withColumnsRenamed({"uri": "p_uri"})
    within = (F.col("uri") == F.col("p_uri")) & (F.col("line") == F.col("start_line")) & F.col("character").between(F.col("start_character"), F.col("end_character"))
    return found.join(p, within).groupBy("uri", "line", "character").agg(F.min_by("finding_id", F.struct("start_character", "finding_id")).alias("finding_id"))


def hover(found: DataFrame, patterns: DataFrame, exposure: DataFrame, verified: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """(finding_id, text): the pattern, how exposed the secret is (finding_id, in_head), and what is known of its verification."""
    advice = patterns.select("pattern_id", F.col("name"), F.col("description"))
    rows = found.join(F.broadcast(advice), "pattern_id", "left").join(exposure, "finding_id", "left")
    parts = ["name", tx.exposure_advice(F.col("in_head"), F.col("description"))]
    if verified is not None:
        rows = rows.join(verified.select(F.col("id").alias("finding_id"), "status", F.col("verified_at").cast("timestamp").alias("at")), "finding_id", "left")
        parts.append(F.when(F.col("status").isNotNull(), F.concat(F.col("status"), F.lit(", verified "), ago(F.col("at"), now if now is not None else F.current_timestamp()))))
    return rows.select("finding_id", F.concat_ws("\n", *parts).alias("text"))


def ago(then: Column, now: Column) -> Column:
    m = F.timestamp_diff("MINUTE", then, now)
    past = lambda n, unit: F.concat(tx.pluralise(n.cast("long"), unit), F.lit(" ago"))
    return F.when(m < 1, "just now").when(m < 60, past(m, "minute")).when(m < 1440, past(F.floor(m / 60), "hour")).otherwise(past(F.floor(m / 1440), "day"))


def fresh_verifications(requests: DataFrame, verified: DataFrame, ttl_s: int = VERIFICATION_TTL_S) -> DataFrame:
    """Of requests (id, ts): the latest verification (id, status, ts) that is at most ``ttl_s`` seconds old, if there is one."""
    v = verified.select(F.col("id").alias("v_id"), F.col("status"), F.col("ts").alias("v_ts"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    age = seconds("ts") - seconds("v_ts")
    known = requests.join(v, (F.col("id") == F.col("v_id")) & (age >= 0) & (age <= ttl_s), "left")
    return known.groupBy("id", "ts").agg(F.max_by("status", "v_ts").alias("status"))


def verification_requests(stream: DataFrame, ttl_s: int = VERIFICATION_TTL_S, in_flight_s: int = IN_FLIGHT_S, lateness: str = LATENESS) -> DataFrame:
    """(id, ask, status) for each row of a stream (id, status, ts; a null status asks, another one answers): a question is passed on
    unless an answer of at most ``ttl_s`` seconds is known or one is under way for less than ``in_flight_s``. State is kept by id and goes
    when the watermark is ``ttl_s`` past its last row, so it holds the ids of a bounded time."""

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, at, asked = state.get if state.exists else ("", 0, 0)
        out, last = [], 0
        for f in frames:
            for r in f.sort_values("ts").itertuples():
                now = int(r.ts.timestamp() * 1000)
                last = max(last, now)
                if isinstance(r.status, str):
                    status, at, asked = r.status, now, 0
                elif status and now - at <= ttl_s * 1000:
                    out.append((key[0], False, status))
                elif asked and now - asked < in_flight_s * 1000:
                    out.append((key[0], False, None))
                else:
                    asked = now
                    out.append((key[0], True, None))
        state.update((status, at, asked))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + ttl_s * 1000)
        yield pd.DataFrame(out, columns=["id", "ask", "status"]).astype({"ask": bool})

    return stream.withWatermark("ts", lateness).groupBy("id").applyInPandasWithState(step, "id string, ask boolean, status string", "status string, at long, asked long", "append", "EventTimeTimeout")


def publish(states: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], options: ScanOptions | None = None, minimum: str = "high", ignored: DataFrame | None = None, checkpoint: str | None = None) -> Any:
    """A query that gives ``sink`` (uris, their diagnostics, batch number) for each micro-batch of states (uri, content; a null content
    clears); the sink replaces what it has of these uris, so that a repeated batch changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        sink(batch.select("uri").distinct(), diagnostics(scanned(batch.where("content is not null"), options, minimum, ignored)), number)

    writer = states.writeStream.outputMode("append").foreachBatch(each)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
