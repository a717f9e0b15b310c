"""Configuration: TOML read into a dataclass, unknown keys left out of account, and written whole."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..catalogue import Pattern, PatternError, Registry, check_regex, severity
from ..operators.suppress import write_whole
from .files import MAX_FILE_SIZE

IGNORE = "fingerprint string, pattern_id string, file string, reason string"


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass
class Config:
    severity: str | None = None
    minimum_confidence: str = "high"
    exclude_paths: list[str] = field(default_factory=list)
    max_file_size: int | None = None
    patterns: list[Pattern] = field(default_factory=list)
    disabled_patterns: list[str] = field(default_factory=list)
    baseline_path: str | None = None
    ignore: list[dict[str, str]] = field(default_factory=list)

    def registry(self, base: Registry | None = None) -> Registry:
        return (base or Registry()).configured(tuple(self.disabled_patterns), tuple(self.patterns))

    def check(self, spark: SparkSession) -> Config:
        """Raises PatternError for a custom regex that can't be used."""
        for p in self.patterns:
            check_regex(spark, p.regex)
        return self

    def ignores(self, spark: SparkSession) -> DataFrame:
        keys = [c.split()[0] for c in IGNORE.split(", ")]
        return spark.createDataFrame([tuple(i.get(k) for k in keys) for i in self.ignore], IGNORE)


def parse(text: str) -> Config:
    try:
        raw = tomllib.loads(text)
        custom = [
            Pattern(p["id"], p["name"], severity(p["severity"]), p["regex"], tuple(p.get("keywords", ())), p.get("min_entropy"), description=p.get("description", "")) for p in raw.get("patterns", [])
        ]
        least = raw.get("minimum_confidence", "high").lower()
        if least not in ("low", "high"):
            raise ConfigError(f"unknown confidence: {least}")
        return Config(severity(raw["severity"]) if "severity" in raw else None, least, list(raw.get("exclude_paths", [])), raw.get("max_file_size"), custom, list(raw.get("disabled_patterns", [])), raw.get("baseline_path"), [dict(i) for i in raw.get("ignore", [])])
    except (tomllib.TOMLDecodeError, KeyError, PatternError) as e:
        raise ConfigError(str(e)) from e


def load(path: str | None) -> Config:
    """The configuration of a file; the defaults where there is none."""
    try:
        return parse(Path(path).read_text(encoding="utf-8")) if path else Config()
    except FileNotFoundError:
        return Config()


def dump(c: Config) -> str:
    """The configuration as TOML."""
    s = lambda x: json.dumps(x, ensure_ascii=False)
    out = [f"severity = {s(c.severity)}"] if c.severity else []
    out += [f"minimum_confidence = {s(c.minimum_confidence)}"] if c.minimum_confidence != "high" else []
    out += [f"exclude_paths = {s(c.exclude_paths)}"] if c.exclude_paths else []
    out += [f"max_file_size = {c.max_file_size}"] if c.max_file_size is not None else []
    out += [f"disabled_patterns = {s(c.disabled_patterns)}"] if c.disabled_patterns else []
    out += [f"baseline_path = {s(c.baseline_path)}"] if c.baseline_path else []
    for p in c.patterns:
        out += ["", "[[patterns]]", f"id = {s(p.id)}", f"name = {s(p.name)}", f"severity = {s(p.severity)}", f"regex = {s(p.regex)}", f"keywords = {s(list(p.keywords))}"]
        out += [f"min_entropy = {float(p.min_entropy)}"] if p.min_entropy is not None else []
        out += [f"description = {s(p.description)}"] if p.description else []
    for i in c.ignore:
        out += ["", "[[ignore]]", *(f"{k} = {s(v)}" for k, v in i.items() if v is not None)]
    return "\n".join(out) + "\n"


def save(c: Config, path: str) -> None:
    write_whole(path, dump(c))


def with_ignore(c: Config, fingerprint: str, pattern_id: str, file: str, reason: str) -> Config:
    """The configuration with one more ignore, in place of one with the same fingerprint. All four values must be there."""
    if not (fingerprint and pattern_id and file and reason):
        raise ConfigError("an ignore needs a fingerprint, a pattern, a file and a reason")
    rest = [i for i in c.ignore if i.get("fingerprint") != fingerprint]
    c.ignore = [*rest, {"fingerprint": fingerprint, "pattern_id": pattern_id, "file": file, "reason": reason}]
    return c


def minimal() -> str:
    return f'severity = "low"\nmax_file_size = {MAX_FILE_SIZE}\n'
