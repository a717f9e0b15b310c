"""Verification of findings against their services: pluggable, off by default, once a finding id."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import Registry

#: A verifier takes a secret and gives (HTTP status or None if the service can't be reached, metadata as label-value pairs).
Verifier = Callable[[str], tuple[int | None, list[tuple[str, str]]]]
VERIFIED = "id string, status string, provider string, metadata array<struct<label:string,value:string>>, verified_at string"
PROVIDERS = {"ai/anthropic": "Anthropic", "ai/openai": "OpenAI", "vcs/github": "GitHub", "payments/stripe": "Stripe"}


#: A transport takes a URL and headers and gives (HTTP status, response headers in lower case, body); it raises OSError if nobody answers.
Transport = Callable[[str, dict[str, str]], tuple[int, dict[str, str], str]]
AGENT = "hushgrid"
TIMEOUT_S = 10


def http(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], str]:
    """The transport that asks for real."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT_S) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode(errors="replace")
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, ""


def _limited(code: int, headers: dict[str, str]) -> list[tuple[str, str]]:
    if code == 429:
        after = headers.get("retry-after")
        return [("Note", f"rate limited, retry after {after} s" if after else "rate limited, try again later")]
    return [] if code in (200, 401, 403) else [("Note", f"unexpected status {code}")]


def key_kind(secret: str) -> str:
    """What an OpenAI key's prefix names."""
    kinds = (("sk-proj-", "Project key"), ("sk-admin-", "Admin key"), ("sk-svcacct-", "Service account key"))
    return next((kind for prefix, kind in kinds if secret.startswith(prefix)), "User key")


def verifiers(transport: Transport = http) -> dict[str, Verifier]:
    """One verifier for each of the four services, over a transport."""

    def github(secret: str) -> tuple[int, list[tuple[str, str]]]:
        code, headers, body = transport("https://api.github.com/user", {"Authorization": f"token {secret}", "User-Agent": AGENT, "Accept": "application/vnd.github+json"})
        about = _limited(code, headers)
        if code == 200:
            try:
                login = json.loads(body).get("login")
            except ValueError:
                login = None
            about = ([("User", login)] if login else []) + ([("Scopes", headers["x-oauth-scopes"])] if headers.get("x-oauth-scopes") else [])
        return code, about + ([("Note", "authenticated, insufficient permissions")] if code == 403 else [])

    def stripe(secret: str) -> tuple[int, list[tuple[str, str]]]:
        code, headers, _ = transport("https://api.stripe.com/v1/charges?limit=1", {"Authorization": f"Bearer {secret}", "User-Agent": AGENT})
        mode = ("Mode", "test mode" if "_test_" in secret else "live mode")
        own = {200: [mode, ("Access", "restricted key" if secret.startswith("rk_") else "full access")], 403: [mode, ("Note", "restricted key, insufficient permissions")]}
        return code, own.get(code) or _limited(code, headers)

    def openai(secret: str) -> tuple[int, list[tuple[str, str]]]:
        code, headers, _ = transport("https://api.openai.com/v1/models", {"Authorization": f"Bearer {secret}", "User-Agent": AGENT})
        kind = ("Key Type", key_kind(secret))
        return code, {200: [kind], 403: [kind, ("Note", "authenticated, insufficient permissions")]}.get(code) or _limited(code, headers)

    def anthropic(secret: str) -> tuple[int, list[tuple[str, str]]]:
        code, headers, _ = transport("https://api.anthropic.com/v1/models", {"x-api-key": secret, "anthropic-version": "2023-06-01", "User-Agent": AGENT})
        return code, [("Note", "authenticated, insufficient permissions")] if code == 403 else _limited(code, headers)

    return {"GitHub": github, "Stripe": stripe, "OpenAI": openai, "Anthropic": anthropic}


def status_of(code: int | None) -> str:
    """live, inactive or inconclusive, from an HTTP status; 403 is a key that lives with fewer rights."""
    return "live" if code in (200, 403) else "inactive" if code == 401 else "inconclusive"


def provider_of(pattern_id: str) -> str | None:
    return next((v for k, v in PROVIDERS.items() if pattern_id.startswith(k)), None)


def verify(raw: DataFrame, verifiers: dict[str, Verifier], verified_at: str, registry: Registry | None = None) -> DataFrame:
    """(id, status, provider, metadata, verified_at) of the verifiable raw findings (id, pattern_id, secret) whose provider has a verifier. Requests must be
    idempotent: a task that is run again asks again."""
    able = [p.id for p in (registry or Registry()).patterns if p.verifiable and provider_of(p.id) in verifiers]
    once = raw.where(F.col("pattern_id").isin(able)).groupBy("id").agg(F.first("pattern_id").alias("pattern_id"), F.first("secret").alias("secret"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, p, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                provider = provider_of(p)
                try:
                    code, about = verifiers[provider](s)
                except OSError:
                    code, about = None, []
                about = list(about) or ([("Note", "restricted")] if code == 403 else [("Note", "rate limited")] if code == 429 else [])
                out.append({"id": i, "status": status_of(code), "provider": provider, "metadata": [{"label": a, "value": b} for a, b in about], "verified_at": verified_at})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("id", pa.string()), ("status", pa.string()), ("provider", pa.string()), ("metadata", pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())]))), ("verified_at", pa.string())])
    return once.mapInArrow(run, VERIFIED)


def verification_counts(findings: DataFrame, verification: DataFrame) -> DataFrame:
    """One row: live, inactive and skipped findings."""
    s = findings.join(verification.select("id", "status"), "id", "left")
    return s.agg(F.count_if(F.col("status") == "live").alias("live"), F.count_if(F.col("status") == "inactive").alias("inactive"), F.count_if(F.col("status").isNull() | (F.col("status") == "inconclusive")).alias("skipped"))
