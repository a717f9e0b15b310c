"""The builtin pattern catalogue and its registry.

``builtin.txt`` has one pattern a line: id, name, severity, least entropy, keywords, flags (``!`` verifiable, ``=`` assignment
strategy) and regex. Regexes are written with the shorthands of ``SHORT``; ``~`` stands for a group between word boundaries.
"""

from __future__ import annotations

import functools
import pkgutil
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

SEVERITIES = ("low", "medium", "high", "critical")
GENERIC = "generic"

_Q = "'\"`"
SHORT = {
    "an": "[a-zA-Z0-9]",
    "an-": "[a-zA-Z0-9-]",
    "id": "[a-zA-Z0-9_-]",
    "AN": "[A-Z0-9]",
    "d": "[0-9]",
    "hex": "[a-f0-9]",
    "Hex": "[a-fA-F0-9]",
    "b64": "[A-Za-z0-9+/]",
    "uuid": "-".join("[0-9a-f]{%d}" % n for n in (8, 4, 4, 4, 12)),
    "UUID": "-".join("[0-9a-fA-F]{%d}" % n for n in (8, 4, 4, 4, 12)),
    "q?": "['\"]?",
    "is": "[\\s=:]+['\"]?",
    "quote": f"[{_Q}]",
    "value": f"[^\\s{_Q}]{{8,120}}",
    "userinfo": "://[^:]+:" + "[^@]+@" + "[^/\\s\"']+",
    "named": "(?i)" + r"(?:[\w.-]+[_.\-])?",
    "assign": r"(?:[_.\-][\w]*)?" + r"\s*(?:=|:|=>|:=)\s*" + f"[{_Q}]",
}
GROUPS = {
    "ai": ("AI Services", "Revoke the key at the provider and look for calls that aren't yours."),
    "auth": ("Authentication Tokens", "Invalidate the token and look through the access logs."),
    "cloud": ("Cloud Providers", "Revoke the credential in the console at once and look through the audit logs."),
    "custom": ("Custom Patterns", "Rotate the credential at once and look through the access logs."),
    "database": ("Database Credentials", "Change the password at once and look for queries that aren't yours."),
    "email": ("Email Services", "Revoke the key and look for mails that aren't yours."),
    "generic": ("Generic Secrets", "Rotate the credential at once; find out by hand which service it belongs to."),
    "infra": ("Infrastructure Tools", "Revoke the token and look for changes that aren't yours."),
    "keys": ("Private Keys & Certificates", "Revoke the key at once and make a new pair."),
    "messaging": ("Messaging Platforms", "Revoke the token in the app's settings and look for messages that aren't yours."),
    "packages": ("Package & Container Registries", "Revoke the token and check the published versions."),
    "payments": ("Payment Processors", "Roll the key at once and look for charges that aren't yours."),
    "vcs": ("Version Control Systems", "Revoke the token at once and look for commits that aren't yours."),
}


class PatternError(ValueError):
    """A pattern that can't be used."""


@dataclass(frozen=True)
class Pattern:
    id: str
    name: str
    severity: str
    regex: str
    keywords: tuple[str, ...] = ()
    min_entropy: float | None = None
    verifiable: bool = False
    strategy: str = "regex"
    group: str = "custom"
    description: str = ""
    enabled: bool = True

    @property
    def rank(self) -> int:
        return SEVERITIES.index(self.severity)


def severity(text: str) -> str:
    """A severity, whatever its case."""
    low = text.strip().lower()
    if low not in SEVERITIES:
        raise PatternError(f"unknown severity: {text}")
    return low


def expand(short: str) -> str:
    """The regex that a line of the catalogue stands for."""
    body = short[1:] if short.startswith("~") else short
    body = re.sub(r"<pem ([A-Z ]+)>", lambda m: f"-----BEGIN {m[1]}-----[\\s\\S]{{64,}}?-----END {m[1]}-----", body)
    body = re.sub(r"<([a-zA-Z?0-9-]+)>", lambda m: SHORT[m[1]], body)
    return rf"\b({body})\b" if short.startswith("~") else body


@functools.cache
def builtin() -> tuple[Pattern, ...]:
    """All builtin patterns in registry order."""
    out = []
    for line in pkgutil.get_data(__name__, "builtin.txt").decode().splitlines():
        id_, name, sev, entropy, words, flags, regex = (x.strip() for x in line.split("¦"))
        group = id_.partition("/")[0]
        out.append(
            Pattern(id_, name, sev, expand(regex), tuple(w.strip() for w in words.split(" + ")), None if entropy == "-" else float(entropy), "!" in flags, "assignment" if "=" in flags else "regex", group, f"{name}. {GROUPS[group][1]}")
        )
    return tuple(out)


def check_regex(spark: SparkSession, regex: str) -> None:
    """Raises PatternError unless Spark's regex engine takes the regex and it can't match the empty text."""
    try:
        pattern = spark.sparkContext._jvm.java.util.regex.Pattern.compile(regex)
    except Exception as e:
        raise PatternError(f"not a regex: {regex}") from e
    if pattern.matcher("").find():
        raise PatternError(f"matches the empty text: {regex}")


def trie_regex(words: list[str], any_case: bool = False) -> str:
    """A regex whose leftmost match is the longest of the words there: alternatives share no first character, endings are greedy. ``any_case``:
    for RE2, with ASCII letters of either case."""

    def one(c: str) -> str:
        if any_case and (not c.isascii() or "a" <= c <= "z"):
            return f"[{ascii_upper(c)}{c}]" if c.isascii() else c
        return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", c)

    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def build(node: dict) -> str:
        parts = [(one(c) + build(sub)) for c, sub in sorted(node.items()) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in node else "(?:" + "|".join(parts) + ")"
        return body + "?" if "" in node else body

    return build(root)


@dataclass(frozen=True)
class Registry:
    """The patterns of a scan, in order. All of them, whatever their severity, give the prefilter its keywords."""

    patterns: tuple[Pattern, ...] = field(default_factory=builtin)

    def configured(self, disabled: tuple[str, ...] = (), custom: tuple[Pattern, ...] = ()) -> Registry:
        """Without the disabled patterns, with custom ones at the end; a custom pattern is never disabled."""
        return Registry(tuple(p for p in self.patterns if p.id not in disabled) + tuple(replace(p, group="custom", strategy="regex") for p in custom))

    def keywords(self) -> dict[str, list[int]]:
        """Ordinals of the patterns by lower-cased keyword."""
        out: dict[str, list[int]] = {}
        for i, p in enumerate(self.patterns):
            for w in p.keywords:
                low = ascii_lower(w)
                if i not in out.setdefault(low, []):
                    out[low].append(i)
        return out

    def prefilter(self) -> str:
        return trie_regex(sorted(self.keywords()))

    def search(self) -> str:
        """The same search for RE2, over texts as they are; empty without a keyword."""
        return trie_regex(sorted(w for w in self.keywords() if w), any_case=True)

    def runnable(self, least: str = "low") -> list[int]:
        return [i for i, p in enumerate(self.patterns) if p.enabled and p.rank >= SEVERITIES.index(least)]

    def table(self, spark: SparkSession) -> DataFrame:
        """The patterns as rows."""
        rows = [(i, p.id, p.group, p.name, p.description, p.severity, p.rank, p.regex, list(p.keywords), p.enabled, p.min_entropy, p.verifiable, p.strategy) for i, p in enumerate(self.patterns)]
        return spark.createDataFrame(
            rows, "ordinal int, pattern_id string, `group` string, name string, description string, severity string, severity_rank int, regex string, keywords array<string>, default_enabled boolean, min_entropy double, verifiable boolean, strategy string"
        )


def ascii_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def ascii_upper(s: str) -> str:
    return "".join(chr(ord(c) - 32) if "a" <= c <= "z" else c for c in s)


def literal_first(regex: str) -> str:
    r"""A regex with the same matches that begins with its literal, for which the JVM looks by Boyer-Moore: ``\b(key_X)\b`` becomes
    ``key_(?<=\bkey_)X\b``. Others, and those with groups or alternatives within, stay as they are; groups aren't kept."""
    m = re.fullmatch(r"\\b\(([A-Za-z0-9_-]+)([^()|]*)\)\\b", regex, re.S)
    if not m or re.search(r"\\[^.$-]", m[2]):
        return regex
    word, rest = (m[1][:-1], m[1][-1] + m[2]) if m[2][:1] in tuple("?*+{") else (m[1], m[2])
    return rf"{word}(?<=\b{word}){rest}\b" if word else regex


def groups_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, r) for k, (n, r) in GROUPS.items()], "`group` string, name string, remediation string")
