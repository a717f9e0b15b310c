"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from ..catalogue import GROUPS, SEVERITIES, Registry
from ..functions import text as tx
from ..operators import fix as fx
from .corpus import FILES_SQL, HISTORY_SQL, samples

SQL: dict[str, str] = {}


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


R = Registry()
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hits(text: str) -> str:
    return f"list_distinct(regexp_extract_all(translate({text}, '{_UP}', '{_LOW}'), {q(R.prefilter())}))"


def _keywords() -> str:
    return ", ".join(f"({q(w)}, {i})" for w, ids in sorted(R.keywords().items()) for i in ids if R.patterns[i].strategy == "regex")


def _patterns() -> str:
    return ", ".join(f"({i}, {q(p.id)}, {q(p.name)}, {q(p.severity)}, {p.rank}, {q(p.regex)}, {'NULL' if p.min_entropy is None else p.min_entropy}::DOUBLE)" for i, p in enumerate(R.patterns) if p.strategy == "regex")


def entropy(s: str) -> str:
    digits = f"regexp_extract_all(hex(encode({s})), '..')"
    return (
        f"coalesce((SELECT -sum(c / t * log2(c / t)) FROM (SELECT count(*)::DOUBLE AS c, sum(count(*)) OVER ()::DOUBLE AS t FROM (SELECT unnest({digits}) AS d) GROUP BY d)), 0.0)"
    )


def mask(s: str) -> str:
    b = q(tx.BULLETS)
    return f"CASE WHEN length({s}) >= 24 THEN substr({s}, 1, 4) || {b} || right({s}, 4) WHEN length({s}) >= 12 THEN substr({s}, 1, 2) || {b} || right({s}, 2) ELSE {b} END"


def sarif(s: str) -> str:
    return f"CASE WHEN {s} IN ('critical', 'high') THEN 'ERROR' WHEN {s} = 'medium' THEN 'WARNING' ELSE 'INFORMATION' END"


#: From files (path, content) to found, with the secret and the characters before it.
FOUND = f"""pre AS (SELECT path, content, {_hits('content')} AS hits FROM files WHERE content IS NOT NULL AND NOT contains(substr(content, 1, 8000), chr(0))),
kw(keyword, ordinal) AS (VALUES {_keywords()}),
pat(ordinal, pattern_id, name, severity, severity_rank, rx, min_entropy) AS (VALUES {_patterns()}),
cand AS (SELECT DISTINCT path, content, ordinal FROM (SELECT path, content, unnest(hits) AS keyword FROM pre) JOIN kw USING (keyword)),
matched AS (SELECT path, content, ordinal, regexp_extract_all(content, rx) AS m, string_split_regex(content, rx) AS g FROM cand JOIN pat USING (ordinal)),
each AS (SELECT path, content, ordinal, m, g, unnest(range(1, len(m) + 1)) AS i FROM matched),
placed AS (SELECT path, content, ordinal, m[i] AS secret, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS chars FROM each),
around AS (SELECT *, substr(content, 1, chars) AS before, substr(content, chars + length(secret) + 1) AS after FROM placed),
lined AS (SELECT *, string_split(before, chr(10))[-1] AS head, string_split(after, chr(10))[1] AS tail, contains(secret, chr(10)) AS several FROM around),
marked AS (SELECT * FROM lined WHERE NOT contains(head || CASE WHEN several THEN string_split(secret, chr(10))[1] ELSE secret || tail END, {q(tx.IGNORE_MARKER)})),
scored AS (SELECT *, {entropy('secret')} AS bits FROM marked JOIN pat USING (ordinal)),
found AS (SELECT substr(sha256(pattern_id || sha256(secret)), 1, 12) AS id, path, (1 + length(before) - length(replace(before, chr(10), '')))::INTEGER AS line, (length(head) + 1)::INTEGER AS "column",
    strlen(before)::BIGINT AS byte_start, (strlen(before) + strlen(secret))::BIGINT AS byte_end, pattern_id, severity, CASE WHEN min_entropy IS NULL OR bits >= min_entropy THEN 'high' ELSE 'low' END AS confidence,
    head || {mask('secret')} || CASE WHEN several THEN '' ELSE tail END AS masked_line, {mask('secret')} AS secret_masked, sha256(secret) AS secret_hash,
    'sha256:' || sha256(pattern_id || ':' || regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') || ':' || sha256(secret)) AS fingerprint, ordinal, secret, round(bits, 6) AS entropy, content, chars, head, name FROM scored)"""
COLUMNS = 'id, path, line, "column", byte_start, byte_end, pattern_id, severity, confidence, masked_line, secret_masked, secret_hash, fingerprint'
BASE = """ranked AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY path, byte_start, pattern_id) AS n FROM found),
baseline AS (SELECT fingerprint, pattern_id, severity, path AS file, secret_hash, CASE WHEN substr(fingerprint, -2, 1) IN ('0', '1', '2', '3') THEN 'ignored' ELSE 'accepted' END AS status, 'reviewed' AS reason,
    1700000000 + ('0x' || right(fingerprint, 4))::BIGINT AS reviewed_at FROM ranked WHERE n = 1 AND right(fingerprint, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7'))"""


def _scan(select: str, *more: str, files: str = FILES_SQL) -> str:
    return "WITH " + ",\n".join([files, FOUND, *more]) + "\n" + select


_texts = "SELECT 'documents' AS src, doc_id::BIGINT AS row_id, text AS content FROM documents UNION ALL SELECT 'pages', page_id::BIGINT, html FROM pages UNION ALL SELECT 'conversations', conv_id::BIGINT, text FROM conversations"
SQL["keyword_prefilter"] = f"SELECT src, row_id, unnest({_hits('content')}) AS keyword FROM ({_texts})"
SQL["scan_findings"] = _scan(f"SELECT {COLUMNS} FROM found")
SQL["scan_summary"] = _scan("SELECT pattern_id, severity, confidence, count(*) AS n FROM found GROUP BY ALL")
SQL["scan_high_confidence"] = _scan("SELECT path, pattern_id, line, \"column\", byte_start, byte_end FROM found WHERE confidence = 'high'")
SQL["scan_severity_threshold"] = _scan("SELECT severity, count(*) AS n FROM found WHERE severity = 'critical' GROUP BY ALL")
SQL["scan_disabled_and_custom"] = _scan(
    "SELECT pattern_id, confidence, count(*) AS n FROM (SELECT pattern_id, confidence FROM found WHERE pattern_id <> 'vcs/github-pat' UNION ALL "
    f"SELECT 'custom/low', CASE WHEN {entropy('s')} >= 1.0 THEN 'high' ELSE 'low' END FROM (SELECT unnest(regexp_extract_all(content, 'ghp_a{{36}}')) AS s FROM files WHERE contains(lower(content), 'low ='))) GROUP BY ALL"
)
SQL["scan_entropy"] = _scan("SELECT path, pattern_id, byte_start, entropy FROM found")
_ASSIGN = [(i, p) for i, p in enumerate(R.patterns) if p.strategy == "assignment"]
_NAMED = "regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1' || chr(1) || '\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1' || chr(1) || '\\2', 'g')"
_LOOSE = lambda w: chr(1).join([]) + "\x01?".join("\\" + c if not c.isalnum() and c != "_" else c for c in w)
_RX = r"(?m)^([A-Za-z_][A-Za-z0-9_.\-]*)\s*=\s*[''\x22]?([^\s#''\x22]{8,120})[''\x22]?"
_ENV_FILES = "env AS (SELECT 'cfg/.env.' || regexp_extract(path, '([0-9]+)([.][a-z]+)?$', 1) AS path, content FROM files)"
_TRIGGER = " ".join(f"WHEN list_has_any(hits, [{', '.join(q(w) for w in p.keywords)}]) AND regexp_matches(lower({_NAMED}), '(^|[_.\x01-])(' || {q('|'.join(_LOOSE(w) for w in p.keywords))} || ')($|[_.\x01-])') THEN {i}" for i, p in _ASSIGN)
_IDS = " ".join(f"WHEN {i} THEN {q(p.id)}" for i, p in _ASSIGN)
DOTENV = f"""{_ENV_FILES},
env_hits AS (SELECT path, content, {_hits('content')} AS hits FROM env WHERE content IS NOT NULL),
env_rows AS (SELECT path, content, hits, regexp_extract_all(content, '{_RX}') AS m, string_split_regex(content, '{_RX}') AS g, regexp_extract_all(content, '{_RX}', 1) AS names, regexp_extract_all(content, '{_RX}', 2) AS vals FROM env_hits),
env_each AS (SELECT path, content, hits, m, g, names[i] AS name, vals[i] AS val, i FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM env_rows)),
env_placed AS (SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT + length(name) + instr(substr(m[i], length(name) + 1), val) - 1 AS chars FROM env_each WHERE NOT starts_with(val, '$')),
env_named AS (SELECT *, CASE {_TRIGGER} END AS ordinal, substr(content, 1, chars) AS before FROM env_placed),
env_line AS (SELECT *, string_split(before, chr(10))[-1] || val || string_split(substr(content, chars + length(val) + 1), chr(10))[1] AS whole FROM env_named WHERE ordinal IS NOT NULL AND strlen(val) BETWEEN 8 AND 120),
generic AS (SELECT path, CASE ordinal {_IDS} END AS pattern_id, strlen(before)::BIGINT AS byte_start, (strlen(before) + strlen(val))::BIGINT AS byte_end,
    (1 + length(before) - length(replace(before, chr(10), '')))::INTEGER AS line, sha256(val) AS secret_hash, CASE WHEN {entropy('val')} >= 4.0 THEN 'high' ELSE 'low' END AS confidence FROM env_line WHERE NOT contains(whole, {q(tx.IGNORE_MARKER)}))"""
SQL["dotenv_assignments"] = f"WITH {FILES_SQL},\n{DOTENV}\nSELECT * FROM generic"
SQL["generic_dedup"] = f"""WITH {FILES_SQL},\n{FOUND},\n{DOTENV},
specific AS (SELECT 'cfg/.env.' || regexp_extract(path, '([0-9]+)([.][a-z]+)?$', 1) AS path, pattern_id, byte_start, byte_end, confidence FROM found)
SELECT * FROM specific UNION ALL SELECT path, pattern_id, byte_start, byte_end, confidence FROM generic g WHERE NOT EXISTS (
    SELECT 1 FROM specific s WHERE s.path = g.path AND g.byte_start < s.byte_end AND s.byte_start < g.byte_end)"""
SQL["baseline_suppressed"] = _scan("SELECT fingerprint, path, pattern_id, confidence FROM found WHERE fingerprint NOT IN (SELECT fingerprint FROM baseline)", BASE)
SQL["baseline_rows"] = _scan("SELECT * FROM baseline", BASE)
SQL["baseline_upsert"] = _scan(
    "SELECT status, reason, severity, count(*) AS n FROM (SELECT status, reason, severity FROM baseline WHERE fingerprint NOT IN (SELECT fingerprint FROM ranked WHERE severity = 'critical') "
    "UNION ALL SELECT 'ignored', 'again', severity FROM ranked WHERE n = 1 AND severity = 'critical') GROUP BY ALL",
    BASE,
)
SQL["baseline_stats"] = _scan(
    "SELECT 'status' AS kind, status AS name, count(*) AS n, (count(*) * 100 // (SELECT count(*) FROM baseline))::INTEGER AS percent FROM baseline GROUP BY status UNION ALL "
    "SELECT 'severity', severity, count(*), (count(*) * 100 // (SELECT count(*) FROM baseline))::INTEGER FROM baseline GROUP BY severity UNION ALL "
    "SELECT 'total', 'all', count(*), CASE WHEN count(*) > 0 THEN 100 ELSE 0 END::INTEGER FROM baseline",
    BASE,
)
SQL["baseline_top_patterns"] = _scan("SELECT pattern_id, count(*) AS n FROM baseline GROUP BY 1 ORDER BY n DESC, pattern_id LIMIT 10", BASE)
SQL["baseline_review_span"] = _scan(
    "SELECT (SELECT min(reviewed_at) FROM baseline) AS oldest_at, (SELECT fingerprint FROM baseline ORDER BY reviewed_at, fingerprint LIMIT 1) AS oldest, "
    "(SELECT max(reviewed_at) FROM baseline) AS newest_at, (SELECT fingerprint FROM baseline ORDER BY reviewed_at DESC, fingerprint DESC LIMIT 1) AS newest",
    BASE,
)
SQL["scan_stats"] = _scan(
    "SELECT count(*) AS total, count(*) FILTER (k) AS baseline, count(*) FILTER (NOT k AND confidence <> 'high') AS filtered, count(*) FILTER (NOT k AND confidence = 'high') AS shown "
    "FROM (SELECT confidence, fingerprint IN (SELECT fingerprint FROM baseline) AS k FROM found)",
    BASE,
)
_ALL = ", ".join(f"({i}::INTEGER, {q(p.id)}, {q(p.group)}, {q(p.name)}, {q(p.severity)}, {'NULL' if p.min_entropy is None else p.min_entropy}::DOUBLE, {p.verifiable}, {q(p.strategy)}, {q(','.join(p.keywords))})" for i, p in enumerate(R.patterns))
_PATS = f"p(ordinal, pattern_id, \"group\", name, severity, min_entropy, verifiable, strategy, keywords) AS (VALUES {_ALL})"
SQL["pattern_list"] = f"WITH {_PATS} SELECT * FROM p"
SQL["pattern_rollup"] = f'WITH {_PATS} SELECT severity, "group", count(*) AS n FROM p GROUP BY ROLLUP (severity, "group")'
SQL["pattern_groups"] = f'WITH {_PATS}, g("group") AS (VALUES {", ".join(f"({q(k)})" for k in GROUPS)}) SELECT "group", count(pattern_id) AS n FROM g LEFT JOIN p USING ("group") GROUP BY 1'
SQL["findings_rollup"] = _scan("SELECT severity, pattern_id, count(*) AS n FROM found GROUP BY ROLLUP (severity, pattern_id)")
SQL["findings_by_label"] = _scan("SELECT quality, toxic, confidence, count(*) AS n FROM found JOIN labels ON doc_id = regexp_extract(path, '([0-9]+)(\\.[a-z]+)?$', 1)::BIGINT GROUP BY ALL")
SQL["report_json"] = _scan(
    "SELECT path, byte_start, CAST(to_json({'id': id, 'path': path, 'line': line, 'column': \"column\", 'pattern_id': pattern_id, 'severity': severity, 'confidence': confidence, 'secret_masked': secret_masked, 'fingerprint': fingerprint}) AS VARCHAR) AS json FROM found"
)
_ADVICE = " ".join(f"WHEN {q(k)} THEN {q(r)}" for k, (_, r) in GROUPS.items())
SQL["report_text"] = _scan(
    f"""SELECT path, byte_start, upper(severity) || ' ' || pattern_id || ' at ' || path || ':' || line || ':' || "column" || CASE WHEN confidence = 'low' THEN ' (low confidence)' ELSE '' END || CASE WHEN count(*) OVER (PARTITION BY path) > 1 THEN ' [' || row_number() OVER (PARTITION BY path ORDER BY byte_start, pattern_id, byte_end) || ' of ' || count(*) OVER (PARTITION BY path) || ']' ELSE '' END || chr(10) || right('     ' || line, 5) || ' | ' || masked_line || chr(10)
    || repeat(' ', "column" + 7) || repeat('^', length(secret_masked)) || chr(10) || CASE split_part(pattern_id, '/', 1) {_ADVICE} END AS text FROM found"""
)
_BLOBS = HISTORY_SQL + ",\nfiles AS (SELECT DISTINCT path || chr(2) || sha256(content) AS path, content FROM blobs)"
_OCC = "occ AS (SELECT f.* EXCLUDE (path, content), b.path AS path, b.hash, c.date FROM found f JOIN blobs b ON f.path = b.path || chr(2) || sha256(b.content) JOIN commits c USING (hash))"
SQL["history_introductions"] = _scan(
    """SELECT pattern_id, secret_hash, first(id ORDER BY date DESC, hash DESC, path DESC, line DESC, "column" DESC) AS id, first(severity ORDER BY date DESC, hash DESC) AS severity, first(confidence ORDER BY date DESC, hash DESC) AS confidence,
    first(hash ORDER BY date, hash) AS introduced_in, min(date) AT TIME ZONE 'UTC' AS introduced_at, count(*) AS occurrence_count FROM occ GROUP BY pattern_id, secret_hash""",
    _OCC,
    files=_BLOBS,
)
_TREE = "tree AS (SELECT hash, path, sha256(content) AS blob FROM blobs)"
SQL["history_changed_files"] = f"""WITH {HISTORY_SQL}, {_TREE}, old AS (SELECT c.hash, t.path, t.blob AS old FROM commits c JOIN tree t ON t.hash = c.parent)
SELECT t.hash, t.path, t.blob FROM tree t LEFT JOIN old USING (hash, path) WHERE t.blob IS DISTINCT FROM old.old"""
SQL["history_staged"] = f"WITH {FILES_SQL} SELECT path, sha256(content) AS blob FROM files WHERE content IS NOT NULL AND substr(sha256(path), 1, 1) NOT IN ('0', '1', '2', '3', '4', '5', '6', '7')"
SQL["history_walk"] = f"WITH {HISTORY_SQL} SELECT hash, date AT TIME ZONE 'UTC' AS date FROM commits WHERE date <= TIMESTAMP '2023-11-14 23:59:59' ORDER BY commits.date DESC, hash LIMIT 100"
SQL["history_adjacent"] = _scan(
    "SELECT pattern_id, count(*) AS n FROM (SELECT *, lag(hash) OVER (PARTITION BY pattern_id, secret_hash ORDER BY date DESC, hash, path, line, \"column\") AS last FROM occ) WHERE hash IS DISTINCT FROM last GROUP BY 1", _OCC, files=_BLOBS
)


def comment(path: str, marker: str = tx.IGNORE_MARKER) -> str:
    ext = f"lower(regexp_extract({path}, '[^/]\\.([^./]+)$', 1))"
    whens = " ".join(f"WHEN {ext} IN ({', '.join(q(x) for x in names.split())}) THEN {q(f'{start} {marker}' + (f' {end}' if end else ''))}" for (start, end), names in tx.COMMENTS.items())
    return f"CASE {whens} END"


#: Files with three more findings, two of them on one line; edits go into the text one by one, each moved by what the ones before it added.
_SEVERAL = FILES_SQL.replace("files AS (", "plain AS (", 1) + """,
files AS (SELECT path, 'two = ghp_' || substr(sha256(path), 1, 36) || ' or ghp_' || substr(sha256(path), 9, 36) || chr(10) || chr(10) || 'key ghp_' || substr(sha256(path), 17, 36) || chr(10) || content AS content FROM plain)"""
_TAIL_END = "chars + length(secret) + length(string_split(substr(content, chars + length(secret) + 1), chr(10))[1])"


def _fix(a: str, b: str, new: str) -> str:
    edits = f"edits AS (SELECT DISTINCT path, content, a, b, new FROM (SELECT path, content, {a} AS a, {b} AS b, {new} AS new FROM found) WHERE new IS NOT NULL)"
    pieces = "pieces AS (SELECT *, substr(content, coalesce(lag(b) OVER w, 0) + 1, a - coalesce(lag(b) OVER w, 0)) || new AS piece FROM edits WINDOW w AS (PARTITION BY path ORDER BY a))"
    return _scan("SELECT path, sha256(string_agg(piece, '' ORDER BY a) || substr(first(content), max(b) + 1)) AS sha, count(*)::INTEGER AS n_edits FROM pieces GROUP BY path", edits, pieces, files=_SEVERAL)


SQL["fix_redact"] = _fix("chars", "chars + length(secret)", q(fx.REDACTED))
SQL["fix_placeholder"] = _fix("chars", "chars + length(secret)", "'${' || upper(replace(split_part(pattern_id, '/', -1), '-', '_')) || '}'")
SQL["fix_delete"] = _fix("chars - length(head)", f"least(length(content), {_TAIL_END} + 1)", "''")
SQL["fix_ignore"] = _fix(_TAIL_END, _TAIL_END, f"(' ' || {comment('path')})")
_SAMPLES = ", ".join(f"({i}, {q(p)}, {q(sev)})" for i, (found, _) in enumerate(samples()) for p, sev in found)
SQL["scan_every_pattern"] = f"""WITH s(i, pattern_id, severity) AS (VALUES {_SAMPLES})
SELECT doc_id::VARCHAR AS path, pattern_id, severity, (2 + length(text) - length(replace(text, chr(10), '')))::INTEGER AS line FROM documents JOIN s ON ((doc_id % {len(samples())}) + {len(samples())}) % {len(samples())} = i WHERE text IS NOT NULL"""
SQL["findings_by_file"] = _scan(
    "SELECT path, count(*)::INTEGER AS n, CAST(to_json(list({'byte_start': byte_start, 'line': line, 'column': \"column\", 'pattern_id': pattern_id, 'severity': severity, 'confidence': confidence, 'id': id} ORDER BY byte_start, line, \"column\", pattern_id, severity, confidence, id)) AS VARCHAR) AS findings FROM found GROUP BY path"
)
_LEVEL = lambda s: f"CASE WHEN {s} IN ('critical', 'high') THEN 'error' WHEN {s} = 'medium' THEN 'warning' ELSE 'note' END"
_RULE = f"CAST(to_json({{'id': pattern_id, 'name': name, 'shortDescription': {{'text': description}}, 'defaultConfiguration': {{'level': {_LEVEL('severity')}}}}}) AS VARCHAR)"
_PATTERN_ROWS = "pr(ordinal, pattern_id, name, description, severity) AS (VALUES " + ", ".join(f"({i}, {q(p.id)}, {q(p.name)}, {q(p.description)}, {q(p.severity)})" for i, p in enumerate(R.patterns)) + ")"
_SARIF_HEAD = """SELECT 0::INTEGER AS part, '' AS at, 0::BIGINT AS n, '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"hushgrid","rules":[' || string_agg(""" + _RULE + """, ',' ORDER BY ordinal) || ']}},"results":[' AS text FROM pr"""
_AT = lambda p, l, c: f"[{{'physicalLocation': {{'artifactLocation': {{'uri': {p}}}, 'region': {{'startLine': {l}, 'startColumn': {c}}}}}}}]"
_SARIF_LOC = _AT("path", "line", '"column"')
SQL["report_sarif"] = _scan(
    f"""{_SARIF_HEAD} UNION ALL SELECT 1, path, byte_start, CAST(to_json({{'ruleId': pattern_id, 'level': {_LEVEL('severity')}, 'message': {{'text': pattern_id || ': ' || secret_masked}}, 'locations': {_SARIF_LOC}, 'fingerprints': {{'secret/v1': fingerprint}}}}) AS VARCHAR) FROM found
    UNION ALL SELECT 2, '', 0, ']}}]}}'""",
    _PATTERN_ROWS,
)
_ISO = lambda d: f"strftime({d}, '%Y-%m-%dT%H:%M:%SZ')"
_INTRO = """intro AS (SELECT pattern_id, secret_hash, count(*) AS occurrence_count, first(o ORDER BY o.date DESC, o.hash DESC, o.path DESC, o.line DESC, o."column" DESC, o.masked_line DESC) AS latest,
    list(o ORDER BY o.date, o.hash, o.path, o.line, o."column", o.masked_line) AS every FROM (SELECT pattern_id, secret_hash, {'date': date, 'hash': hash, 'path': path, 'line': line, 'column': "column", 'masked_line': masked_line, 'secret_masked': secret_masked, 'id': id, 'severity': severity, 'confidence': confidence} AS o FROM occ) GROUP BY 1, 2),
told AS (SELECT *, every[1] AS x FROM intro)"""
_SEEN = lambda x: f"{{'commit': {{'hash': {x}.hash, 'date': {_ISO(x + '.date')}}}, 'location': {{'path': {x}.path, 'line': {x}.line, 'column': {x}.\"column\"}}, 'line_content': {x}.masked_line}}"
SQL["history_report"] = _scan(
    """SELECT 0::INTEGER AS part, '' AS at, 0::BIGINT AS n, '{"version":"1.0","scan_type":"history","summary":' || CAST(to_json({'secrets_found': count(*), 'total_occurrences': coalesce(sum(occurrence_count), 0)::BIGINT, 'by_severity': {"""
    + ", ".join(f"'{x}': count(*) FILTER (latest.severity = '{x}')" for x in ("critical", "high", "medium", "low"))
    + """}}) AS VARCHAR) || ',"findings":[' AS text FROM told UNION ALL SELECT 1, """
    + _ISO("x.date")
    + f""" || ' ' || pattern_id, 0, CAST(to_json({{'id': latest.id, 'pattern_id': pattern_id, 'severity': latest.severity, 'confidence': latest.confidence, 'secret_masked': latest.secret_masked, 'introduced_in': {_SEEN('x')}, 'occurrences': list_transform(every, lambda e: {_SEEN('e')}), 'occurrence_count': occurrence_count}}) AS VARCHAR) FROM told
    UNION ALL SELECT 2, '', 0, ']}}'""",
    "@OCC",
)
SQL["history_tree"] = _scan(
    """SELECT pattern_id, latest.id AS id, upper(latest.severity) || ' ' || pattern_id || ' · ' || occurrence_count || CASE WHEN occurrence_count = 1 THEN ' occurrence' ELSE ' occurrences' END || chr(10) || '  ' || x.masked_line || chr(10) ||
    list_aggregate(list_transform(once, lambda e, i: CASE WHEN i = len(once) THEN '  └─ ' ELSE '  ├─ ' END || substr(e.hash, 1, 7) || ' ' || e.path || ':' || e.line || ' · ' || strftime(e.date, '%Y-%m-%d') || CASE WHEN e.hash = x.hash THEN ' (introduced)' ELSE '' END), 'string_agg', chr(10)) AS text
    FROM (SELECT *, list_filter(every, lambda e, i: i = 1 OR e.hash <> every[i - 1].hash) AS once FROM told)""",
    "@OCC",
)
_HIST_LOC = _AT("x.path", "x.line", 'x."column"')
SQL["history_report_sarif"] = _scan(
    f"""{_SARIF_HEAD} WHERE pattern_id IN (SELECT pattern_id FROM told) UNION ALL SELECT 1, {_ISO('x.date')} || ' ' || pattern_id, 0, CAST(to_json({{'ruleId': pattern_id, 'level': {_LEVEL('latest.severity')}, 'message': {{'text': pattern_id || ' in the history'}}, 'locations': {_HIST_LOC}, 'fingerprints': {{'secret/v1': latest.id}},
    'properties': {{'scan_type': 'history', 'commit': {{'hash': x.hash, 'date': {_ISO('x.date')}}}, 'occurrence_count': occurrence_count}}}}) AS VARCHAR) FROM told UNION ALL SELECT 2, '', 0, ']}}]}}'""",
    "@OCC",
    _PATTERN_ROWS,
)
SQL["finding_context"] = _scan(
    """SELECT f.path, l.number::INTEGER AS number, CASE WHEN EXISTS (SELECT 1 FROM found g WHERE g.path = f.path AND g.line = l.number) THEN (SELECT first(masked_line ORDER BY byte_start) FROM found g WHERE g.path = f.path AND g.line = l.number) ELSE l.text END AS text, l.number = f.line AS is_finding
    FROM found f JOIN (SELECT path, unnest(range(1, len(x) + 1)) AS number, unnest(x) AS text FROM (SELECT path, string_split(content, chr(10)) AS x FROM files)) l ON l.path = f.path AND l.number BETWEEN f.line - 1 AND f.line + 1"""
)
SQL["repeated_lines"] = _scan("SELECT path, line, 2 * count(*) AS n FROM found GROUP BY ALL")
SQL["debounce_sessions"] = """WITH e AS (SELECT user_id AS uri, props AS content, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY uri ORDER BY ts) AS k FROM e)
SELECT uri, first(content ORDER BY ts DESC, content DESC NULLS LAST) AS content, max(ts) AS ts, count(*) AS n_edits FROM s GROUP BY uri, k"""
SQL["verification_cache"] = """WITH ask AS (SELECT DISTINCT user_id AS id, ts FROM events WHERE event_type = 'click' AND ts IS NOT NULL), known AS (SELECT user_id AS id, ts, max(props) AS status FROM events WHERE event_type = 'purchase' AND ts IS NOT NULL GROUP BY 1, 2)
SELECT a.id, a.ts, arg_max(k.status, k.ts) AS status FROM ask a LEFT JOIN known k ON k.id = a.id AND k.ts <= a.ts AND epoch_us(a.ts) - epoch_us(k.ts) <= 3600000000 GROUP BY 1, 2"""
_ABLE = ", ".join(q(p.id) for p in R.patterns if p.verifiable)
SQL["editor_diagnostics"] = _scan(
    f"""SELECT path AS uri, line - 1 AS start_line, "column" - 1 AS start_character, line - 1 AS end_line, ("column" - 1 + byte_end - byte_start)::INTEGER AS end_character, {sarif('severity')} AS severity,
    name || ' found' AS message, CASE WHEN confidence = 'low' THEN 'unnecessary' END AS tag,
    '{{"fingerprint":"' || fingerprint || '","finding_id":"' || id || '","verifiable":' || CASE WHEN pattern_id IN ({_ABLE}) THEN 'true' ELSE 'false' END || '}}' AS data, pattern_id, fingerprint FROM found"""
)
_VERIFIABLE = ", ".join(q(p.id) for p in R.patterns if p.verifiable)
_CALLED = f"called AS (SELECT *, {comment('path')} IS NOT NULL AS known, pattern_id IN ({_VERIFIABLE}) AS able, count(*) OVER (PARTITION BY path, line) AS on_line FROM found)"
SQL["editor_actions"] = _scan(
    "SELECT title, count(*) AS n FROM (SELECT 'Ignore on this line' AS title FROM called WHERE known UNION ALL SELECT 'Ignore in the configuration' FROM called UNION ALL SELECT 'Verify' FROM called WHERE able "
    "UNION ALL SELECT 'Ignore all on this line' FROM called WHERE known AND on_line > 1) GROUP BY 1",
    _CALLED,
)
_DESCRIBED = ", ".join(f"({q(p.id)}, {q(p.description)})" for p in R.patterns)
SQL["editor_hover"] = _scan(
    "SELECT id AS finding_id, first(name || chr(10) || CASE WHEN substr(id, 1, 1) < '8' THEN 'It is committed. ' || description ELSE 'It isn''t committed yet: take it out before you commit.' END) AS text FROM found JOIN described USING (pattern_id) GROUP BY id",
    f"described(pattern_id, description) AS (VALUES {_DESCRIBED})",
)
_LIVE = "substr(secret_hash, 1, 1) < '8'"
_ASKED = "(pattern_id LIKE 'vcs/github%' OR pattern_id LIKE 'payments/stripe%') AND pattern_id IN (" + _VERIFIABLE + ")"
SQL["verification"] = _scan(f"SELECT count(*) FILTER ({_ASKED} AND {_LIVE}) AS live, count(*) FILTER ({_ASKED} AND NOT {_LIVE}) AS inactive, count(*) FILTER (NOT ({_ASKED})) AS skipped FROM found")
SQL["key_types"] = _scan(
    "SELECT pattern_id, CASE WHEN pattern_id LIKE 'payments/stripe%' THEN CASE WHEN contains(secret, '_test_') THEN 'Test key' WHEN starts_with(secret, 'rk_') THEN 'Restricted key' WHEN contains(secret, '_live_') THEN 'Live key' END END AS key_type, count(*) AS n FROM found GROUP BY ALL"
)
_EXT = ", ".join(q(x) for x in tx.BINARY_EXTENSIONS)
SQL["file_filters"] = f"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '\\?.*$', '') || CASE ((page_id % 3) + 3) % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.html' ELSE '.min.js' END AS path, html FROM pages)
SELECT page_id, path, regexp_matches(path, '\\.min\\.js$') OR regexp_matches('/' || path, '/vendor/') OR starts_with(path, 'build/') OR regexp_matches(path, '(^|/)2[^/]*\\.html$') AS is_excluded,
    lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) IN ({_EXT}) AS binary_name, contains(substr(html, 1, 8000), chr(0)) AS binary_text, strlen(html) > 4096 AS too_large FROM p"""
_LANG = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in tx.LANGUAGES.items())
SQL["text_functions"] = f"""WITH {FILES_SQL}, d AS (SELECT path, content, string_split(content, chr(10))[-1] AS line FROM files)
SELECT path, round({entropy('line')}, 6) AS line_entropy, {mask('line')} AS masked, path AS normal_path, CASE regexp_extract(path, '[^/]\\.([^./]+)$', 1) {_LANG} END AS language,
    regexp_matches(path, '(^|/)\\.env(\\.[^/]*)?$') AS dotenv, {comment('path')} AS comment, upper(replace(split_part(path, '/', -1) || '-key', '-', '_')) AS env_name,
    replace(regexp_extract(line, '"[^"]*"'), '"', '') AS unquoted, CASE WHEN length(line) > 12 THEN substr(line, 1, 11) || '…' ELSE line END AS short,
    CASE WHEN length(line) % 3 = 1 THEN '1 line' ELSE (length(line) % 3) || ' lines' END AS plural,
    CASE WHEN strlen(content) * 100 < 1024 THEN (strlen(content) * 100) || 'B' WHEN strlen(content) * 100 < 1048576 THEN (strlen(content) * 100 // 1024) || 'KB' ELSE (strlen(content) * 100 // 1048576) || 'MB' END AS file_size,
    CASE WHEN strlen(content) / 64.0 < 1 THEN floor(strlen(content) / 64.0 * 1000)::BIGINT || 'ms' WHEN strlen(content) / 64.0 < 60 THEN format('{{:.1f}}s', round(strlen(content) / 64.0, 1)) ELSE floor(strlen(content) / 64.0 / 60)::BIGINT || 'm ' || floor(strlen(content) / 64.0 % 60)::BIGINT || 's' END AS duration FROM d"""
SQL["project_kinds"] = """WITH m(k, kind, globs) AS (VALUES (0, 'rust', ['target/']), (11, 'node', ['build/', 'dist/', 'node_modules/']), (22, 'go', ['vendor/']), (33, 'jvm', ['.gradle/', 'build/', 'target/'])),
x AS (SELECT source AS root, kind, unnest(globs) AS g FROM documents JOIN m ON ((doc_id % 40) + 40) % 40 = k WHERE source IS NOT NULL)
SELECT root, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, string_agg(DISTINCT g, ',' ORDER BY g) AS excludes FROM x GROUP BY root"""
for _name in ("history_report", "history_tree", "history_report_sarif"):
    SQL[_name] = SQL[_name].replace(FILES_SQL, _BLOBS, 1).replace("@OCC", _OCC + ",\n" + _INTRO)
assert SEVERITIES
