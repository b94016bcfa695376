"""The derived tables and rule functions in DuckDB SQL, written apart from the Spark plans.

Only the fixed patterns and constants are shared.
"""

from __future__ import annotations

from recollect.functions import patterns as P
from recollect.sources.memories import AS_OF, CUSTOMER, NATION, REGION, SUPPLIER, TEMPLATES

NOW = f"TIMESTAMP '{AS_OF}'"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def any_of(x: str, *patterns: str) -> str:
    return "(" + " OR ".join(has(x, p) for p in patterns) + ")"


def group(x: str, pattern: str, n: int) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {n})"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def rounded(x: str, digits: int) -> str:
    return f"(floor(({x}) * {float(10**digits)!r}::DOUBLE + 0.5::DOUBLE) / {float(10**digits)!r}::DOUBLE)"


def category(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(f'lower({x})', p)} THEN '{kind}'" for kind, p in P.CATEGORY_PATTERNS) + " ELSE 'fact' END"


def importance_steps(x: str, kind: str) -> str:
    """A select list item; steps are nested as the rule clamps at each."""
    low = f"lower({x})"
    out = "CASE " + " ".join(f"WHEN {kind} = '{k}' THEN {v}::DOUBLE" for k, v in P.TYPE_IMPORTANCE.items()) + f" ELSE {P.BASE_IMPORTANCE}::DOUBLE END"
    for pattern, by in ((P.CRITICAL, 0.15), (P.SECURITY, 0.2), (P.IDENTITY_HINT, 0.1)):
        out = f"list_transform([{out}], lambda v: CASE WHEN {has(low, pattern)} THEN least(1.0::DOUBLE, v + {by}::DOUBLE) ELSE v END)[1]"
    out = f"list_transform([{out}], lambda v: CASE WHEN length(trim({x})) < 30 THEN greatest(0.1::DOUBLE, v - 0.15::DOUBLE) ELSE v END)[1]"
    out = f"CASE WHEN {has(low, P.TRIVIAL_OPENER)} THEN 0.1::DOUBLE ELSE {out} END"
    out = f"list_transform([{out}], lambda v: CASE WHEN {has(low, P.UNCERTAIN)} THEN greatest(0.1::DOUBLE, v - 0.1::DOUBLE) ELSE v END)[1]"
    return rounded(f"greatest(0.1::DOUBLE, least(1.0::DOUBLE, {out}))", 2)


def attribute(x: str) -> str:
    low = f"lower({x})"
    obj = lambda p, n: sub(sub(f"trim({group(low, p, n)})", r"[.!?,;]+$", ""), r"\s+", "_")
    verb = lambda p: f"{sub(group(low, p, 1), r'\s+', '_')} || '_' || {obj(p, 2)}"
    said = group(low, P.IDENTITY, 0)
    return f"""CASE WHEN {has(low, P.NEGATED_PREFERENCE)} THEN {verb(P.NEGATED_PREFERENCE)}
        WHEN {has(low, P.SWITCHED)} THEN 'use_' || {obj(P.SWITCHED, 1)}
        WHEN {has(low, P.PREFERENCE)} THEN {verb(P.PREFERENCE)}
        WHEN {has(low, P.IDENTITY)} THEN CASE WHEN {has(said, 'name|called')} THEN 'name' WHEN {has(said, 'work|job|employ')} THEN 'employer' ELSE 'identity' END
        WHEN {has(low, P.TECH)} THEN 'tech_' || {group(low, P.TECH, 1)}
        WHEN {has(low, P.PROJECT)} THEN 'project_' || {sub(f"trim({group(low, P.PROJECT, 1)})", r'\s+', '_')}
        ELSE '' END"""


def prefix(kind: str, entity: str, attr: str, session: str) -> str:
    joined = f"""concat_ws(', ', CASE WHEN {kind} NOT IN ('fact', 'general') THEN upper({kind}[1]) || {kind}[2:] END,
        CASE WHEN {entity} <> '' AND {attr} <> '' THEN 'about ' || {entity} || '''s ' || replace({attr}, '_', ' ') END,
        CASE WHEN {session} <> '' THEN 'in session ' || {session}[1:8] END)"""
    return f"CASE WHEN {joined} = '' THEN '' ELSE {joined} || ':' END"


def value_case(x: str, what: str) -> str:
    """One of value, negated, past, replaced of what a text says."""
    low = f"lower({x})"
    rows = (
        (P.VALUE_NEGATED, group(low, P.VALUE_NEGATED, 1), "true", "false", "NULL"),
        (P.VALUE_PAST, group(low, P.VALUE_PAST, 1), "true", "true", "NULL"),
        (P.VALUE_SWITCHED, group(low, P.VALUE_SWITCHED, 2), "false", "false", group(low, P.VALUE_SWITCHED, 1)),
        (P.VALUE_POSITIVE, group(low, P.VALUE_POSITIVE, 1), "false", "false", "NULL"),
        (P.VALUE_IDENTITY, f"trim({group(low, P.VALUE_IDENTITY, 1)})", "false", "false", "NULL"),
    )
    at = ("value", "negated", "past", "replaced").index(what) + 1
    end = "NULL" if what in ("value", "replaced") else "false"
    return "CASE " + " ".join(f"WHEN {has(low, r[0])} THEN {r[at]}" for r in rows) + f" ELSE {end} END"


def corrected(x: str, kind: str) -> str:
    low = f"lower({x})"
    rules = " ".join(
        f"WHEN {has(low, p)} AND {kind} IN ({', '.join(map(lit, wrong))}) THEN '{right}'" for p, right, wrong in P.CORRECTIONS
    )
    return f"CASE WHEN {kind} IN ('profile', 'general') THEN NULL {rules} END"


def intent(x: str) -> str:
    q = f"trim({x})"
    return f"""CASE WHEN {any_of(q, *P.IDENTIFIER_PATTERNS)} THEN 'identifier' WHEN {any_of(q, *P.EXACT_PATTERNS)} THEN 'exact'
        WHEN len(string_split_regex({q}, '\\s+')) <= 3 OR {any_of(q, *P.CONCEPTUAL_PATTERNS)} THEN 'conceptual' ELSE 'mixed' END"""


def terms(x: str) -> str:
    out = sub(x, r"\w+:", "")
    out = sub(out, r"(?i)\b(?:AND|OR|NOT|NEAR)\b", "")
    out = sub(sub(out, "['\"*^$]", ""), r"[^a-zA-Z0-9_\s]", " ")
    return f"trim({sub(out, r'\s+', ' ')})"


def _fill(template: str) -> str:
    return "replace(replace(" + lit(template) + ", '{a}', a), '{b}', b)"


STATEMENTS = f"""
    w AS (SELECT doc_id AS id, source AS session_id, text, regexp_extract_all(text, '[A-Za-z]{{3,}}') AS ws FROM documents),
    ab AS (SELECT id, session_id, text, lower(coalesce(ws[1], 'alpha')) AS a, lower(coalesce(ws[len(ws)], 'beta')) AS b FROM w),
    statements AS (SELECT id, session_id,
        CASE id % {len(TEMPLATES)} {' '.join(f'WHEN {n} THEN {_fill(t)}' for n, t in enumerate(TEMPLATES))} END
        || '.' || chr(10) || coalesce(text, '') AS text FROM ab)"""

ENRICHED = f"""{STATEMENTS},
    e1 AS (SELECT *, {category('text')} AS type FROM statements),
    e2 AS (SELECT *, {importance_steps('text', 'type')} AS importance, {attribute('text')} AS attribute FROM e1),
    e3 AS (SELECT *, CASE WHEN attribute <> '' THEN 'user' ELSE '' END AS entity FROM e2),
    enriched AS (SELECT *, {prefix('type', 'entity', 'attribute', 'session_id')} AS context_prefix FROM e3)"""

CITATIONS = """
    citations AS (SELECT event_id % greatest((SELECT count(*) FROM documents), 1) AS memory_id, user_id AS session, event_type AS kind, ts AS cited_at FROM events)"""

MEMORIES = f"""{ENRICHED}, {CITATIONS},
    recalls AS (SELECT memory_id, count(*) AS recalls FROM citations WHERE kind = 'view' GROUP BY 1),
    memories AS (SELECT id, session_id, CASE WHEN id % 23 = 0 THEN 'general' ELSE type END AS type, text,
        CASE WHEN id < 60 OR id % 10 IN (4, 5, 6) THEN 'superseded' WHEN id % 29 = 7 THEN 'archived' WHEN id % 31 = 9 THEN 'invalid' ELSE 'active' END AS status,
        CASE WHEN id < 60 OR id % 10 IN (4, 5, 6) THEN id + 1 END AS superseded_by,
        id % 3 AS use_count, {NOW} - to_days(CAST(id % 400 AS INT)) AS created_at, coalesce(recalls, 0) AS recall_count,
        importance, context_prefix, entity, attribute,
        CASE WHEN id % 11 = 3 THEN {NOW} - to_days(CAST(id % 400 - 30 AS INT)) END AS valid_until, CAST(id % 3 AS INT) AS compression_level
        FROM enriched LEFT JOIN recalls ON id = memory_id)"""

VECTORS = "vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"

EDGES = f"""
    raw_edges AS (
        SELECT CAST(n_nationkey + {NATION} AS BIGINT) AS from_id, CAST(n_regionkey + {REGION} AS BIGINT) AS to_id, 'part_of' AS relation, CAST(n_nationkey AS BIGINT) AS k FROM nation
        UNION ALL SELECT s_suppkey + {SUPPLIER}, s_nationkey + {NATION}, 'located_in', s_suppkey FROM supplier
        UNION ALL SELECT c_custkey + {CUSTOMER}, c_nationkey + {NATION}, 'lives_in', c_custkey FROM customer
        UNION ALL SELECT n_regionkey + {REGION}, min(n_nationkey) + {NATION}, 'led_by', min(n_nationkey) FROM nation GROUP BY n_regionkey),
    edges AS (SELECT from_id * 8 + CASE WHEN relation = 'led_by' THEN 1 ELSE 0 END AS id, from_id, to_id, relation, (k % 10 + 1) / 10.0::DOUBLE AS strength,
        CASE WHEN k % 7 = 2 THEN {NOW} - to_days(CAST(k % 50 - 10 AS INT)) END AS valid_until FROM raw_edges)"""

TURNS = """
    real_turns AS (SELECT u.conv_id, u.turn, u.text AS user_message, coalesce(r.text, '') AS assistant_response
        FROM conversations u LEFT JOIN conversations r ON u.conv_id = r.conv_id AND u.turn + 1 = r.turn AND r.role = 'assistant' WHERE u.role = 'user'),
    turns AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, user_message, assistant_response FROM real_turns
        UNION ALL SELECT CAST(conv_id AS VARCHAR), -1 - turn, CASE (conv_id + turn) % 7 WHEN 0 THEN 'ok' ELSE 'I prefer dark mode for reading' END, ''
        FROM real_turns WHERE (conv_id + turn) % 7 IN (0, 1))"""


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


def decayed(score: str) -> str:
    """Decay of a row of memories."""
    by = lambda at: "CASE type " + " ".join(f"WHEN '{k}' THEN {'NULL' if v[at] is None else repr(v[at])}::DOUBLE" for k, v in P.DECAY.items()) + f" ELSE {P.DECAY['general'][at]}::DOUBLE END"
    age = f"greatest((epoch_us({NOW}) - epoch_us(created_at)) / 86400000000.0::DOUBLE, 0.0::DOUBLE)"
    ext = "least((0.5::DOUBLE + CASE WHEN importance = 0 THEN 0.5::DOUBLE ELSE importance END) * (1 + 0.3::DOUBLE * recall_count) * (1 + 0.5::DOUBLE * use_count), 10.0::DOUBLE)"
    fresh = f"CASE WHEN type = 'profile' THEN 1.0::DOUBLE ELSE exp(-pow({age} / (({by(0)}) * {ext}), {by(1)})) END"
    held = "(1 - exp(-(recall_count / 3.0::DOUBLE)))"
    return rounded(f"{score} * (0.4::DOUBLE + 0.25::DOUBLE * ({fresh}) + 0.2::DOUBLE * importance + 0.15::DOUBLE * {held})", 3)
