"""Assignments of string literals to telling names, in source code and dotenv files.

A tolerant lexer per language knows comments and strings, so a name in a comment or a call's result never counts; source that
doesn't parse is read as far as it goes. The languages' full grammars aren't followed: a literal counts if it is the whole value of an
assignment, a declaration, a keyword argument or a map entry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_DELIMITERS = "_.-"
_DOTENV = re.compile(r"^([A-Za-z_][A-Za-z0-9_.\-]*)\s*=\s*['\x22]?([^\s#'\x22]{8,120})['\x22]?", re.M)
_LEXERS = {
    "python": (r"#[^\n]*", r"\"\"\"(?:\\.|(?!\"\"\").)*\"\"\"|'''(?:\\.|(?!''').)*'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", ("=", ":")),
    "javascript": (r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", ("=", ":")),
    "go": (r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])*'", ("=", ":=", ":")),
    "ruby": (r"#[^\n]*", r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", ("=", ":", "=>")),
    "java": (r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", ("=",)),
    "rust": (r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", ("=",)),
}
_LEXERS["typescript"] = _LEXERS["javascript"]
_COMPILED: dict[str, re.Pattern[str]] = {}


def _lexer(language: str) -> re.Pattern[str]:
    if language not in _COMPILED:
        comment, string, _ = _LEXERS[language]
        _COMPILED[language] = re.compile(rf"(?P<c>{comment})|(?P<s>{string})|(?P<n>[@$]{{0,2}}[^\W\d]\w*[?!]?(?==[=>]|(?<![?!]))|[^\W\d]\w*)|(?P<o>:=|=>|==|!=|<=|>=|\+=|::|->|[^\w\s])|(?P<l>\n)", re.S)
    return _COMPILED[language]


def is_trigger(name: str, words: tuple[str, ...]) -> bool:
    """Whether a word is a segment of the name: bounded by its ends, by _ . - or by a change of case."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)

    def upper(c: str) -> bool:
        return "A" <= c <= "Z"

    def lower(c: str) -> bool:
        return "a" <= c <= "z"

    def case(i: int) -> bool:
        if i == 0 or not upper(name[i]):
            return False
        return lower(name[i - 1]) or (upper(name[i - 1]) and i + 1 < len(name) and lower(name[i + 1]))

    for w in words:
        at = low.find(w)
        while w and at >= 0:
            end = at + len(w)
            if (at == 0 or low[at - 1] in _DELIMITERS or case(at)) and (end == len(low) or low[end] in _DELIMITERS or case(end)):
                return True
            at = low.find(w, at + 1)
    return False


def strip_quotes(s: str) -> str:
    return s[1:-1] if len(s) >= 2 and s[0] in "\"'`" and s[0] == s[-1] else s


def code_values(content: str, language: str) -> Iterator[tuple[str, str, int]]:
    """(name, value as its node is written, characters before it) of the literals that are assigned."""
    ops = _LEXERS[language][2]
    tokens = [(m.lastgroup, m.group(), m.start()) for m in _lexer(language).finditer(content) if m.lastgroup != "c"]
    solid = [t for t in tokens if t[0] != "l"]
    ends = {}  # of each solid token, whether a line ends right after it
    k = -1
    for t in tokens:
        if t[0] == "l":
            ends[k] = True
        else:
            k += 1
    for i, (kind, text, at) in enumerate(solid):
        if kind != "s" or i < 2 or solid[i - 1][1] not in ops or text.startswith(('"""', "'''")):
            continue
        if language in ("javascript", "typescript", "go") and text[0] == "`":
            continue
        if language in ("go", "java", "rust") and text[0] == "'":
            continue
        last = i + 1 == len(solid) or ends.get(i, False) or solid[i + 1][1] in (";", ",", ")", "}", "]")
        if not last:
            continue
        op, (name_kind, name, _) = solid[i - 1][1], solid[i - 2]
        if op == "=" and language in ("typescript", "rust", "python"):  # name: type = value
            j = i - 2
            while j > 0 and solid[j][1] not in (":", ";", "{", "}", ",", "=") and not ends.get(j - 1, False):
                j -= 1
            if j > 0 and solid[j][1] == ":" and solid[j - 1][0] == "n":
                name_kind, name = solid[j - 1][:2]
        if op == "=" and language == "go" and i > 2 and solid[i - 3][0] == "n" and solid[i - 3][1] not in ("var", "const") and not ends.get(i - 3, False):
            name_kind, name = solid[i - 3][:2]  # var name type = value
        if op == "=" and name_kind != "n":
            continue
        if op in (":", "=>") and name_kind not in ("n", "s"):
            continue
        if op == ":" and language == "python" and name_kind != "s":
            continue
        inner = language != "go"
        yield strip_quotes(name).lstrip("@$"), text[1:-1] if inner else text, at + inner


def dotenv_values(content: str) -> Iterator[tuple[str, str, int]]:
    for m in _DOTENV.finditer(content):
        if not m[2].startswith("$"):
            yield m[1], m[2], m.start(2)


def assigned(files: DataFrame, words: dict[int, tuple[str, ...]]) -> DataFrame:
    """Files (path, content, candidates) with ``assigned``, the array of (ordinal, secret, value, chars) of their literals: the first pattern, in
    order, one of whose words is in the name takes the literal. Values have 8 to 120 bytes. Only texts with candidates and a known language or
    dotenv name go to Python."""
    from pyspark.sql import functions as F

    from ..functions import text as tx

    item = pa.struct([("ordinal", pa.int32()), ("secret", pa.string()), ("value", pa.string()), ("chars", pa.int32())])

    @F.arrow_udf("array<struct<ordinal:int,secret:string,value:string,chars:int>>")
    def literals(contents: pa.Array, candidates: pa.Array, languages: pa.Array) -> pa.Array:
        out = []
        for content, wanted, lang in zip(contents.to_pylist(), candidates.to_pylist(), languages.to_pylist(), strict=True):
            got = []
            if content is not None:
                groups = [(i, words[i]) for i in sorted(wanted)]
                for name, node, at in code_values(content, lang) if lang else dotenv_values(content):
                    value = strip_quotes(node)
                    if 8 <= len(value.encode()) <= 120:
                        i = next((i for i, w in groups if is_trigger(name, w)), None)
                        if i is not None:
                            got.append({"ordinal": i, "secret": node, "value": value, "chars": at})
            out.append(got)
        return pa.array(out, pa.list_(item))

    path = F.col("path")
    routed = (F.size("candidates") > 0) & (tx.is_dotenv(path) | tx.language(path).isNotNull())
    return files.withColumn("assigned", literals(F.when(routed, F.col("content")), F.col("candidates"), F.when(~tx.is_dotenv(path), tx.language(path))))
