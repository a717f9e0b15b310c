"""Text functions as native column expressions: entropy, masks, positions, identities, routes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BULLETS = "•" * 8
#: A line with this text is left out of scans; the scan's configuration can name another one.
IGNORE_MARKER = "hushgrid:ignore"
BINARY_PREFIX = 8000
BINARY_EXTENSIONS = tuple(
    "a avi avif bin bmp bundle bz2 class dat dll dylib eot exe flac gif gz heic heif ico jpeg jpg m4a mkv mov mp3 mp4 o obj ogg otf pak png pyc pyo rar rlib rmeta so tar tif tiff ttf wasm wav webm webp woff woff2 xz zip zst 7z".split()
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rb": "ruby", "java": "java", "rs": "rust"}
#: Comment syntax: (start, end) and the file extensions that have it.
COMMENTS = {
    ("//", ""): "c h cpp cc cxx hpp hxx hh cs fs fsx fsi go groovy gradle java js mjs cjs jsx kt kts m mm php rs scala sc swift ts mts cts tsx zig dart proto v odin jsonc",
    ("#", ""): "coffee ex exs jl nim nims pl pm p6 pm6 raku ps1 psm1 psd1 py pyw pyi r rb rake gemspec sh bash zsh ksh tcl toml yml yaml fish nix cr",
    ("--", ""): "hs lhs lua sql ada adb ads elm purs vhd vhdl",
    (";", ""): "clj cljs cljc edn lisp lsp cl scm ss rkt asm s ini properties",
    ("%", ""): "bib erl hrl tex sty cls mat pro",
    ("'", ""): "vb vbs bas",
    ("/*", "*/"): "css scss less",
    ("<!--", "-->"): "html htm xml xsl xslt svg vue svelte astro md markdown",
}


def ascii_lower(s: Column) -> Column:
    return F.translate(s, _UPPER, _LOWER)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def entropy(s: Column) -> Column:
    """Shannon entropy in bits of the UTF-8 bytes; 0 for the empty text."""
    digits = F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit(".."), F.lit(0))
    share = lambda every, x: F.size(F.filter(every, lambda y: y == x)) / F.size(every).cast("double")
    term = lambda every, x: bound(share(every, x), lambda p: p * F.log2(p))
    return bound(digits, lambda every: F.aggregate(F.array_distinct(every), F.lit(0.0), lambda acc, x: acc - term(every, x)))


def confidence(value: Column, least: Column) -> Column:
    """high without a least entropy or at it and above, otherwise low."""
    return F.when(least.isNull() | (entropy(value) >= least), "high").otherwise("low")


def mask(s: Column) -> Column:
    """The ends of the text around eight bullets: four characters from 24 on, two from 12 on, none below."""
    n = F.char_length(s)
    ends = lambda k: F.concat(F.substring(s, 1, k), F.lit(BULLETS), F.substring(s, -k, k))
    return F.when(n >= 24, ends(4)).when(n >= 12, ends(2)).otherwise(F.lit(BULLETS))


def is_binary(s: Column) -> Column:
    """A NUL within the first 8000 bytes."""
    return F.locate("\0", F.substring(F.encode(s, "UTF-8"), 1, BINARY_PREFIX).cast("string")) > 0


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty without a dot, or with a leading one only."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def has_binary_extension(path: Column) -> Column:
    return F.lower(extension(path)).isin(*BINARY_EXTENSIONS)


def normalise_path(path: Column) -> Column:
    """Slashes forward, all leading ./ gone."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def fingerprint(pattern_id: Column, path: Column, secret_hash: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(":", pattern_id, normalise_path(path), secret_hash), 256))


def finding_id(pattern_id: Column, secret_hash: Column) -> Column:
    """12 hex digits that depend on the pattern and the secret alone."""
    return F.substring(F.sha2(F.concat(pattern_id, secret_hash), 256), 1, 12)


def lines(before: Column) -> Column:
    """1-based line of what follows a text."""
    return (1 + F.char_length(before) - F.char_length(F.replace(before, F.lit("\n")))).cast("int")


def line_of(text: Column, chars: Column) -> Column:
    """1-based line of the character after so many characters."""
    return lines(F.substring(text, F.lit(1), chars))


def column_of(text: Column, chars: Column) -> Column:
    """1-based column, in characters."""
    return (F.char_length(F.substring_index(F.substring(text, F.lit(1), chars), "\n", -1)) + 1).cast("int")


def is_dotenv(path: Column) -> Column:
    return path.rlike(r"(^|/)\.env(\.[^/]*)?$")


def language(path: Column) -> Column:
    """The language of assignments to look for, by the extension as it is written; null for others."""
    ext = extension(path)
    out = None
    for k, v in LANGUAGES.items():
        out = F.when(ext == k, v) if out is None else out.when(ext == k, v)
    return out


def comment_syntax(path: Column) -> Column:
    """A struct of how a comment starts and ends, by extension; null where it isn't known."""
    ext, out = F.lower(extension(path)), None
    for (start, end), names in COMMENTS.items():
        here, syntax = ext.isin(*names.split()), F.struct(F.lit(start).alias("start"), F.lit(end).alias("end"))
        out = F.when(here, syntax) if out is None else out.when(here, syntax)
    return out


def comment_ignore(path: Column, marker: str = IGNORE_MARKER) -> Column:
    """The ignore marker as a comment of the file's language."""
    c = comment_syntax(path)
    return F.when(c["end"] == "", F.concat(c["start"], F.lit(f" {marker}"))).otherwise(F.concat(c["start"], F.lit(f" {marker} "), c["end"]))


def env_name(pattern_id: Column) -> Column:
    """The environment variable that stands for a pattern's secret."""
    return F.upper(F.replace(F.element_at(F.split(pattern_id, "/"), -1), F.lit("-"), F.lit("_")))


def strip_quotes(s: Column) -> Column:
    """Without one pair of equal quotes around it."""
    return F.regexp_replace(s, r"(?s)^([\"'`])(.*)\1$", "$2")


def truncate(s: Column, n: int) -> Column:
    return F.when(F.char_length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def pluralise(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def file_size(n: Column) -> Column:
    """In whole units, rounded down."""
    return F.when(n < 1024, F.format_string("%dB", n)).when(n < 1 << 20, F.format_string("%dKB", F.shiftright(n, 10))).otherwise(F.format_string("%dMB", F.shiftright(n, 20)))


def duration(seconds: Column) -> Column:
    return F.when(seconds < 1, F.format_string("%dms", (seconds * 1000).cast("long"))).when(seconds < 60, F.format_string("%.1fs", seconds)).otherwise(F.format_string("%dm %ds", (seconds / 60).cast("long"), (seconds % 60).cast("long")))


def severity_rank(s: Column) -> Column:
    return F.when(s == "low", 0).when(s == "medium", 1).when(s == "high", 2).when(s == "critical", 3)


def sarif_level(s: Column) -> Column:
    return F.when(s.isin("critical", "high"), "error").when(s == "medium", "warning").otherwise("note")


def editor_severity(s: Column) -> Column:
    return F.when(s.isin("critical", "high"), "ERROR").when(s == "medium", "WARNING").otherwise("INFORMATION")


def key_type(pattern_id: Column, secret: Column) -> Column:
    """What kind of key a secret's prefix names, for the providers that have kinds."""
    ai = F.when(secret.startswith("sk-proj-"), "Project key").when(secret.startswith("sk-admin-"), "Admin key").when(secret.startswith("sk-svcacct-"), "Service account key").when(secret.startswith("sk-None-"), "Unscoped key")
    pay = F.when(secret.contains("_test_"), "Test key").when(secret.startswith("rk_"), "Restricted key").when(secret.contains("_live_"), "Live key")
    return F.when(pattern_id.startswith("ai/openai"), ai).when(pattern_id.startswith("payments/stripe"), pay)


def exposure_advice(in_head: Column, remediation: Column) -> Column:
    """Advice by exposure: committed, not committed, unknown (null)."""
    return F.when(in_head, F.concat(F.lit("It is committed. "), remediation)).when(~in_head, F.lit("It isn't committed yet: take it out before you commit.")).otherwise(remediation)
