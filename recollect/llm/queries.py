"""The registered queries of the numbered operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import chat, decontam, fingerprint, lexical, licenses, lm, mixing, phrases, quality, repeats, secrets, simhash, warc
from recollect.session import scratch_root, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    made = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.unionByName(made)))


ORACLE_SQL["op1_chat"] = """
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), e AS (
        SELECT *, length(role) + length(text) + 24
            + len(regexp_extract_all(role || text, '\\\\')) + len(regexp_extract_all(role, '(<|\\[)(/?(s>|INST\\]))'))
            + len(regexp_extract_all(text, '(<|\\[)(/?(s>|INST\\]))')) AS chars FROM t
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id"""


@_query
def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


@_query
def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"),
    )


@_query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in secrets.BASE_RULES]
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    of_base = F.filter("found", lambda x: x["kind"].isin(base))
    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(secrets.spans_text(of_base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("found")).alias("spans"),
    )


def _spans_sql(rule: secrets.Rule, nth: int) -> str:
    """A list of (start, nth, end) in DuckDB, by another route: running sums over all earlier pieces."""
    regex = rule.regex.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{regex}')) + 1), lambda i: {{
        'start': CAST(list_sum(list_transform(string_split_regex(t, '{regex}')[1:i], lambda x: length(x)))
               + coalesce(list_sum(list_transform(regexp_extract_all(t, '{regex}')[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
        'nth': {nth}, 'n': length(regexp_extract_all(t, '{regex}')[i]),
        'good': length(regexp_extract_all(t, '{regex}', {rule.group})[i]) >= {rule.least}}}), lambda x: x.good)"""


def _secrets_sql() -> str:
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in secrets.RULES) + "]"
    lists = ", ".join(f"{_spans_sql(r, i)} AS s{i}" for i, r in enumerate(secrets.RULES))
    n = len(secrets.BASE_RULES)
    merged = lambda k: "list_sort(" + "flatten([" + ", ".join(f"s{i}" for i in range(k)) + "]))"
    text = lambda k: (
        f"array_to_string(list_transform({merged(k)}, lambda x: {kinds}[x.nth + 1] || ':' || x.start || ':' || (x.start + x.n)), ',')"
    )
    counts = ", ".join(f"CAST(len(s{i}) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(secrets.BASE_RULES))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, {lists} FROM d)
        SELECT doc_id, {counts}, sha256({text(n)}) AS base_sha256, {text(len(secrets.RULES))} AS spans FROM s"""


ORACLE_SQL["op5_secrets"] = _secrets_sql()


@_query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(_table(spark, sf_dir, "documents"))


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@_query
def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(_table(spark, sf_dir, "documents"))


@_query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@_query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path).select(
        "record_id",
        "kind",
        "page_id",
        "refers_to",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    )
    records = written(records, "warc-records")
    responses = records.where("kind = 'response'").drop("refers_to")
    again = records.where("kind = 'revisit'").select("page_id", F.col("refers_to").alias("record_id"))
    of = responses.select("record_id", F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        responses.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
        .select(*columns)
        .unionByName(again.join(of, "record_id", "left").withColumn("record_type", F.lit("revisit")).select(*columns))
    )


ORACLE_SQL["op10_warc"] = """
    WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY page_id NULLS LAST) AS k,
                 first_value(page_id) OVER (PARTITION BY digest ORDER BY page_id NULLS LAST) AS f FROM p)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
        CASE WHEN k = 1 OR n < 100 THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN k > 1 AND n >= 100 THEN f END AS refers_to FROM r"""


@_query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_phrases"] = r"""
    WITH w AS (
        SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(x, '[ \t]+'), lambda y: y <> '') AS words FROM (
            SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\n\x0B\f\r]')) AS x FROM documents)
    ), g AS (
        SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
        FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(words) >= k
    ), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND f >= 10),
    cuts AS (
        SELECT c.*, j, array_to_string(words[1:j], ' ') AS head, array_to_string(words[j + 1:k], ' ') AS tail
        FROM c, (SELECT unnest([1, 2]) AS j) WHERE j < k
    ), s AS (
        SELECT cuts.*, h.f AS l, t.f AS r, CAST((CAST(a AS HUGEINT) * a * 1000000) // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
        FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail
    ), m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    inside AS (
        SELECT lang, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase, a AS longer FROM c WHERE k = 3
    ), kept AS (
        SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = m.lang AND i.phrase = m.phrase AND 100 * i.longer >= 50 * m.a)
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000"""


@_query
def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove(_table(spark, sf_dir, "documents")))


@_query
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(_table(spark, sf_dir, "documents"))
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.search(index, items).withColumnRenamed("query_id", "item_id")


ORACLE_SQL["op13_lexical"] = r"""
    WITH t AS (
        SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
        UNION ALL SELECT 'q', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
    ), w AS (SELECT kind, id, unnest(regexp_extract_all(x, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM t),
    p AS (SELECT id AS doc_id, term, count(*) AS tf FROM w WHERE kind = 'd' GROUP BY ALL),
    n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
    c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    m AS (SELECT doc_id, 10 + (90 * n * big_n) // big_l AS m FROM n, c),
    q AS (SELECT DISTINCT id AS item_id, term FROM w WHERE kind = 'q'),
    s AS (
        SELECT item_id, p.doc_id, CAST(sum(CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df.df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
        FROM q JOIN p ON p.term = q.term JOIN df ON df.term = q.term JOIN m ON m.doc_id = p.doc_id, c GROUP BY ALL
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 10"""


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # a script beside the package, so not at import

    return corpus_pipeline.run(spark, sf_dir)
