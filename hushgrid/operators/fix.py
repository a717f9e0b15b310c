"""Rewriting files: secrets redacted, replaced by placeholders, their lines deleted or marked.

All edits are computed from the original text, from its end to its start, so no edit shifts another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .scan import ScanOptions, nested

REDACTED = "<REDACTED>"
ACTIONS = ("redact", "placeholder", "delete", "ignore")


def _replace_spans(text: Column, edits: Column) -> Column:
    """The text with characters [a, b) of each edit, in descending order and without overlap, replaced by ``new``."""
    return F.aggregate(edits, text, lambda t, e: F.concat(F.substring(t, F.lit(1), e["a"]), e["new"], F.substring(t, e["b"] + 1, F.lit(1 << 30))))


def _edit(x: Column, action: str, marker: str, env_names: Column) -> Column:
    """The edit (a, b, new) of a placed match, in characters of the content; null where there is none."""
    a, b = x["chars"], x["chars"] + F.char_length(x["secret"])
    edit = lambda a, b, new: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), new.alias("new"))
    if action == "redact":
        return edit(a, b, F.lit(REDACTED))
    if action == "placeholder":
        return edit(a, b, F.concat(F.lit("${"), env_names[x["ordinal"]], F.lit("}")))
    start, end = a - F.char_length(x["head"]), b + F.char_length(x["tail"])
    if action == "delete":  # the lines of the secret with the feed after them
        return edit(start, F.least(end + 1, F.char_length("content")), F.lit(""))
    first = F.when(F.instr(x["secret"], "\n") > 0, a + F.char_length(F.substring_index(x["secret"], "\n", 1))).otherwise(end)
    comment = tx.comment_ignore(F.col("path"), marker)
    return F.when(comment.isNotNull(), edit(first, first, F.concat(F.lit(" "), comment)))


def fixed(files: DataFrame, action: str, options: ScanOptions | None = None) -> DataFrame:
    """(path, content, n_edits) of the files that an action changes. No confidence and no baseline is looked at.

    Overlapping secrets are edited once, from the first's start; a line is deleted or marked once. ``ignore`` leaves
    files alone whose comments aren't known. Each row is edited for itself, without a shuffle, whatever path others have. Nothing is written: the
    rows are the new contents."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}")
    o = options or ScanOptions()
    names = F.expr("array(" + ", ".join("'" + p.id.rpartition("/")[2].replace("-", "_").upper().replace("'", "") + "'" for p in o.registry.patterns) + ")")
    every = F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda x: _edit(x, action, o.marker, names)), lambda e: e.isNotNull())))
    # without overlaps: an edit that begins before the last one's end, or where it begins, is left out
    start = F.array().cast("array<struct<a:int,b:int,new:string>>")
    late = lambda acc, e: (F.size(acc) > 0) & ((e["a"] < F.get(acc, F.size(acc) - 1)["b"]) | (e["a"] == F.get(acc, F.size(acc) - 1)["a"]))
    clear = F.aggregate(every, start, lambda acc, e: F.when(late(acc, e), acc).otherwise(F.concat(acc, F.array(e))))
    row = nested(files, o).select("path", "content", F.explode(F.array(F.struct(clear.alias("es")))).alias("x"))  # computed once a row
    done = row.select("path", "content", "x.es").where(F.size("es") > 0)
    return done.select("path", _replace_spans(F.col("content"), F.reverse("es")).alias("content"), F.size("es").alias("n_edits"))


def preview(files: DataFrame, action: str, options: ScanOptions | None = None) -> DataFrame:
    """(path, number, old, new) of the lines that differ; deleted lines have no new text. Old lines may show secrets: for eyes, not logs."""
    new = fixed(files, action, options)
    line = lambda df, name: df.select("path", F.posexplode(F.split("content", "\n", -1)).alias("n", name))
    old = line(files.join(new.select("path"), "path", "left_semi"), "old")
    if action == "delete":
        return old.join(line(new, "new").select("path", F.col("new").alias("old")).distinct(), ["path", "old"], "left_anti").select("path", (F.col("n") + 1).cast("int").alias("number"), "old", F.lit(None).cast("string").alias("new"))
    return old.join(line(new, "new"), ["path", "n"]).where("old <> new").select("path", (F.col("n") + 1).cast("int").alias("number"), "old", "new")
