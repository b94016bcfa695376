"""More queries of the memory engine: lookups, blocks, vectors, expansion, recall, parsing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import patterns as P
from recollect.functions import text as X
from recollect.operators import context, graph, limits, mutations, retrieval
from recollect.plans import duck as D
from recollect.plans.registry import ANY, DAY, KNN, QUERY_STEP, RELEASE, _STOP, _asked, _day, query
from recollect.session import scratch_root
from recollect.sources import memories as M
from recollect.sources.store import Store
from recollect.sources.vector_index import VectorIndex


@query(f"WITH {D.MEMORIES} SELECT id, type, status FROM memories WHERE id IN (SELECT item_id FROM benchmark)")
def point_lookup(spark, d):
    ids = M.table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    return retrieval.lookup(M.memories(spark, d), ids).select("id", "type", "status")


@query(f"WITH {KNN} SELECT query_id, id, {D.rounded('c', 3)} AS score, CAST(rank AS INT) AS rank FROM near WHERE rank <= 10 AND c > 0.3")
def vector_search(spark, d):
    """The exact search with its least similarity."""
    v = M.vectors(spark, d)
    return retrieval.knn(v.where(F.col("id") % QUERY_STEP == 0), v, 10, 0.3)


_KEYWORDS = f"array_to_string(list_filter(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]{{2,}}'), lambda w: NOT list_contains({_STOP}, lower(w)))[1:5], ' ')"
_BY_KEYWORDS = ANY.replace("SELECT item_id AS query_id, text FROM benchmark", f"SELECT item_id AS query_id, {_KEYWORDS} AS text FROM benchmark")


def _keywords(spark, d) -> DataFrame:
    """The keywords of each benchmark item."""
    words = F.array_join(X.keywords(F.col("text")), " ")
    return M.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("text")).where("text <> ''")


@query(f"WITH {D.MEMORIES}, {_BY_KEYWORDS} SELECT query_id, id, round(bm25, 6) AS bm25, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10")
def keyword_search(spark, d):
    found = retrieval.keyword_hits(M.text_index(spark, d), M.memories(spark, d), _keywords(spark, d), 10)
    return found.select("query_id", "id", F.round("bm25", 6).alias("bm25"), "rank")




@query(
    f"""WITH {D.MEMORIES}, {ANY}, a AS (SELECT query_id, id, 0 AS variant, rank FROM ranked WHERE rank <= 30),
    k AS (SELECT * FROM (WITH {_BY_KEYWORDS} SELECT query_id, id, 1 AS variant, rank FROM ranked WHERE rank <= 30)),
    f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min((variant, rank)) AS first FROM (SELECT * FROM a UNION ALL SELECT * FROM k) GROUP BY 1, 2)
    SELECT query_id, id, round(rrf, 9) AS rrf, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first, id) AS INT) AS rank FROM f QUALIFY rank <= 10"""
)
def expanded_search(spark, d):
    """Each benchmark item by its whole text and by its keywords."""
    variants = _asked(spark, d).withColumn("variant", F.lit(0)).unionByName(_keywords(spark, d).withColumn("variant", F.lit(1)))
    found = retrieval.expanded(M.text_index(spark, d), M.memories(spark, d), variants, 10)
    return found.select("query_id", "id", F.round("rrf", 9).alias("rrf"), "rank")


_CHAIN = """chain AS (SELECT id AS from_id, lag(id) OVER (PARTITION BY entity, attribute ORDER BY id) AS to_id FROM memories WHERE status = 'active' AND entity <> '' AND attribute <> '')"""


@query(
    f"""WITH {D.MEMORIES}, {_CHAIN}, steps AS (WITH RECURSIVE g(start, node, depth) AS (SELECT id, id, 0 FROM memories WHERE status = 'active'
        UNION ALL SELECT g.start, c.to_id, g.depth + 1 FROM g JOIN chain c ON c.from_id = g.node WHERE c.to_id IS NOT NULL AND g.depth < 3) SELECT * FROM g)
    SELECT start, node AS to_id, depth, text AS to_text, type AS to_type FROM steps LEFT JOIN memories ON id = node WHERE depth > 0"""
)
def graph_steps(spark, d):
    """Up to three steps along the edges of the same entity, with what is there."""
    rows = M.memories(spark, d)
    edges = graph.same_entity_edges(rows).withColumn("valid_until", F.lit(None).cast("timestamp"))
    starts = rows.where("status = 'active'").select(F.col("id").alias("start"))
    return graph.with_memories(graph.traverse(edges, starts, M.as_of(), 3), rows).select("start", "to_id", "depth", "to_text", "to_type")


_CORE = """core AS (SELECT p_brand AS key, arg_max(p_name, p_partkey)[1:500] AS value FROM part GROUP BY 1)"""


def _core(spark, d) -> DataFrame:
    part = M.table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("value"), F.col("p_partkey").alias("at"))
    return mutations.upserted_blocks(part.limit(0), part)


@query(f"WITH {_CORE} SELECT key, value, CAST(row_number() OVER (ORDER BY key) AS INT) AS rank FROM core")
def core_block_list(spark, d):
    lines = context.core_lines(_core(spark, d), 100_000)
    split = F.split("line", r"\] ", 2)
    return lines.select(F.substring(split[0], 7, 500).alias("key"), split[1].alias("value"), "rank")


@query(f"WITH {_CORE} SELECT key, value FROM core WHERE key NOT IN (SELECT p_brand FROM part WHERE p_size = 50)")
def core_block_delete(spark, d):
    keys = M.table(spark, d, "part").where("p_size = 50").select(F.col("p_brand").alias("key"))
    return mutations.removed_blocks(_core(spark, d), keys).select("key", "value")


@query(f"WITH {_CORE} SELECT key, value FROM core WHERE key IN (SELECT p_brand FROM part WHERE p_size = 50)")
def core_block_get(spark, d):
    keys = M.table(spark, d, "part").where("p_size = 50").select(F.col("p_brand").alias("key")).distinct()
    return _core(spark, d).join(keys, "key", "left_semi").select("key", "value")


@query(f"WITH {D.MEMORIES}, {_CORE}, {RELEASE} SELECT session_id, 'memory' AS part, CAST(id AS VARCHAR) AS key, line AS text FROM used WHERE used <= 8000 UNION ALL SELECT NULL, 'core', key, value FROM core")
def release_answer(spark, d):
    """The lines of each session, and the core blocks that belong to every answer."""
    lines = context.release(M.memories(spark, d), M.as_of(), 2000)
    memory = lines.select("session_id", F.lit("memory").alias("part"), F.col("id").cast("string").alias("key"), F.col("line").alias("text"))
    core = _core(spark, d).select(F.lit(None).cast("string").alias("session_id"), F.lit("core").alias("part"), "key", F.col("value").alias("text"))
    return memory.unionByName(core)


@query(
    f"""WITH {D.MEMORIES}, {_CORE}, {ANY}, {_CHAIN},
    c AS (SELECT '[core:' || key || '] ' || value AS line, row_number() OVER (ORDER BY key) AS rank, sum(length('[core:' || key || '] ' || value) + 1) OVER (ORDER BY key) AS used FROM core),
    s AS (SELECT query_id, id, r.rank, type, text, entity FROM ranked r JOIN memories USING (id) WHERE r.rank <= 5),
    e AS (SELECT id, '(' || type || ') ' || text AS line, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM memories WHERE status = 'active' AND type = 'entity' QUALIFY rank <= 3),
    lines AS (
        SELECT query_id, 0 AS place, 'core' AS source, rank, -rank AS id, line FROM asked, c WHERE used <= 2000
        UNION ALL SELECT query_id, 1, 'search', rank, id, '[' || rank || '] (' || type || ') ' || text FROM s
        UNION ALL SELECT query_id, 2, 'entity', rank, id, line FROM (SELECT DISTINCT query_id FROM s WHERE entity <> ''), e
        UNION ALL SELECT query_id, 3, 'graph', 1, m.id, '(same_entity→' || m.type || ') ' || m.text FROM s JOIN chain ON from_id = s.id JOIN memories m ON m.id = to_id WHERE s.rank = 1),
    once AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY place, rank) = 1),
    u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY query_id ORDER BY place, rank ROWS UNBOUNDED PRECEDING) AS used FROM once)
    SELECT query_id, source, CAST(rank AS INT) AS rank, line FROM u WHERE used <= 2000"""
)
def recall_for_queries(spark, d):
    """What is put before each query: core blocks, hits, entities, neighbours, in 2,000 characters."""
    rows, asked = M.memories(spark, d), _asked(spark, d)
    hits = retrieval.keyword_hits(M.text_index(spark, d), rows, asked, 5)
    return context.recalled_for(asked, hits, rows, graph.same_entity_edges(rows), _core(spark, d), 2_000)


#: Answers of a model: several arrays, one cut off, one of numbers, items without a text or type, an unknown type.
_ANSWER = """CASE doc_id % 5 WHEN 0 THEN 'Sure: [] and [{"text": " said ' || source || ' ' || doc_id || ' ", "type": "preference"}, {"text": "", "type": "fact"}]'
    WHEN 1 THEN '[{"text": "cut ' WHEN 2 THEN 'Here: [{"text": "kept by ' || source || '", "type": "odd", "importance": 0.95}, {"text": "no type"}] and [{"text": "second", "type": "fact"}]'
    WHEN 3 THEN '[1, 2] [{"text": "late", "type": "fact"}]' ELSE '[{"text": "short", "importance": "x"}, {"text": "long enough now", "type": "goal", "importance": 0.1, "sourceUrl": "http://' || lang || '.example"}]' END"""


def _answers(spark, d) -> DataFrame:
    return M.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr(_ANSWER).alias("content"))


@query(
    """SELECT doc_id AS id, 'said ' || source || ' ' || doc_id AS text, 'preference' AS type FROM documents WHERE doc_id % 5 = 0 AND source IS NOT NULL
    UNION ALL SELECT doc_id, 'kept by ' || source, 'fact' FROM documents WHERE doc_id % 5 = 2 AND source IS NOT NULL
    UNION ALL SELECT doc_id, 'long enough now', 'goal' FROM documents WHERE doc_id % 5 = 4 AND lang IS NOT NULL"""
)
def model_memories(spark, d):
    rows = _answers(spark, d).select("id", F.explode(X.extracted_memories(F.col("content"))).alias("m"))
    return rows.select("id", "m.text", "m.type")


@query(
    """SELECT doc_id AS id, 'kept by ' || source AS text, 0.8::DOUBLE AS importance, '' AS source_url FROM documents WHERE doc_id % 5 = 2 AND length('kept by ' || source) > 10
    UNION ALL SELECT doc_id, 'long enough now', 0.3::DOUBLE, 'http://' || lang || '.example' FROM documents WHERE doc_id % 5 = 4 AND lang IS NOT NULL"""
)
def model_facts(spark, d):
    rows = _answers(spark, d).select("id", F.explode(X.researched_facts(F.col("content"))).alias("f"))
    return rows.select("id", "f.text", "f.importance", "f.source_url")


@query(
    """WITH t AS (SELECT user_id, props AS topic, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, topic) AS n FROM t)
    SELECT CAST(user_id AS VARCHAR) AS session_id, topic, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM r WHERE n <= 10 AND ts > TIMESTAMP '2024-01-29 00:00:00' - to_seconds(172800)"""
)
def recent_topics(spark, d):
    topics = M.table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("props").alias("topic"), F.col("ts").cast("timestamp").alias("at"))
    found = context.recent_topics(topics, F.lit("2024-01-29 00:00:00").cast("timestamp"), 10, 172_800)
    return found.select("session_id", "topic", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    """WITH r AS (SELECT page_id // 4 AS query_id, page_id % 4 AS k, url, page_id FROM pages)
    SELECT query_id, string_agg(CASE k WHEN 0 THEN '[Abstract from t' || page_id || ']: s' WHEN 1 THEN '[Answer]: s' ELSE '[' || (k + 1) || '] t' || page_id || chr(10) || ' URL: ' || url || chr(10) || ' s' END, chr(10) || chr(10) ORDER BY k) AS text
    FROM r GROUP BY 1"""
)
def search_answer(spark, d):
    rows = M.table(spark, d, "pages").select(
        F.expr("page_id div 4").alias("query_id"),
        F.when(F.col("page_id") % 4 == 0, "abstract").when(F.col("page_id") % 4 == 1, "answer").otherwise("link").alias("kind"),
        F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title"),
        "url",
        F.lit("s").alias("snippet"),
        (F.col("page_id") % 4 + 1).cast("int").alias("rank"),
    )
    return context.formatted_results(rows)


@query(
    f"""WITH {D.VECTORS}, new AS (SELECT id, list_transform(v, lambda x: -x) AS v FROM vectors WHERE id % 3 = 0 UNION ALL SELECT id + 1000000, v FROM vectors WHERE id % 7 = 0)
    SELECT id, v[1] AS first FROM (SELECT * FROM vectors WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new) WHERE id % 11 <> 5"""
)
def vector_upsert(spark, d):
    v = M.vectors(spark, d)
    new = v.where("id % 3 = 0").select("id", F.transform("v", lambda x: -x).alias("v")).unionByName(v.where("id % 7 = 0").select((F.col("id") + 1_000_000).alias("id"), "v"))
    gone = v.select("id").unionByName(new.select("id")).where("id % 11 = 5").distinct()
    return mutations.upserted_vectors(v, new, gone).select("id", F.get("v", F.lit(0)).alias("first"))


@query(
    f"""WITH {D.MEMORIES} SELECT id, CASE WHEN context_prefix <> '' THEN context_prefix || ' ' ELSE '' END || text AS text FROM memories
    WHERE status = 'active' AND id NOT IN (SELECT vec_id FROM embeddings) ORDER BY id LIMIT 100"""
)
def reembed(spark, d):
    return mutations.to_embed(M.memories(spark, d), M.vectors(spark, d), 100)


@query(f"WITH {D.MEMORIES} SELECT id, CASE WHEN type = 'event' THEN 'archived' ELSE status END AS status FROM memories")
def set_status(spark, d):
    rows = M.memories(spark, d)
    return mutations.with_status(rows, rows.where("type = 'event'").select("id", F.lit("archived").alias("new_status"))).select("id", "status")


@query(
    """WITH c AS (SELECT event_id % greatest((SELECT count(*) FROM documents), 1) AS memory_id, user_id AS session, NULL AS context, ts FROM events
        UNION ALL SELECT doc_id, -1, text[1:200], TIMESTAMP '2024-01-31' FROM documents)
    SELECT memory_id, session, context, strftime(ts, '%Y-%m-%d') AS cited_at FROM c"""
)
def citation_append(spark, d):
    log = M.citations(spark, d).select("memory_id", "session", "cited_at")
    new = M.table(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), F.lit(-1).cast("long").alias("session"), F.col("text").alias("context"), M.as_of().alias("cited_at"))
    return mutations.cited(log, new).select("memory_id", "session", "context", _day("cited_at"))


@query(
    f"""WITH {D.EDGES}, o AS (SELECT from_id AS node, to_id AS other, relation, strength FROM edges WHERE valid_until IS NULL OR valid_until > {D.NOW})
    SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY strength DESC, other) AS INT) AS rank FROM o QUALIFY rank <= 3"""
)
def strongest_neighbours(spark, d):
    edges = M.edges(spark, d)
    nodes = edges.select(F.col("from_id").alias("node")).distinct()
    return graph.strongest(graph.neighbours(edges, nodes, M.as_of()), 3).select("node", "other", "relation", "strength", "rank")


@query(
    """WITH RECURSIVE t AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events),
    s(user_id, us) AS (SELECT user_id, min(us) FROM t GROUP BY 1
        UNION ALL SELECT s.user_id, (SELECT min(t.us) FROM t WHERE t.user_id = s.user_id AND t.us >= s.us + 86400000000) FROM s WHERE s.us IS NOT NULL),
    e AS (SELECT event_id, user_id, ts, (SELECT max(s.us) FROM s WHERE s.user_id = events.user_id AND s.us <= epoch_us(ts)) AS start FROM events)
    SELECT event_id AS id, start, row_number() OVER (PARTITION BY user_id, start ORDER BY ts, event_id) <= 3 AS allowed FROM e"""
)
def rate_limit(spark, d):
    """Three events a day of each user, days counted from the first event on."""
    rows = M.table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    return limits.rate_limited(rows, 86_400, 3).select("id", F.unix_micros("start").alias("start"), "allowed")


@query(f"WITH {KNN} SELECT query_id, id, round(c, 6) AS cosine, CAST(rank AS INT) AS rank FROM near WHERE rank <= 10")
def indexed_vector_search(spark, d):
    """What knn_search finds, by the stored index."""
    v = M.vectors(spark, d)
    index = VectorIndex.create(v, f"{scratch_root(spark)}/vectors-{uuid.uuid4().hex}")
    found = index.search(v.where(F.col("id") % QUERY_STEP == 0), 10)
    return found.select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


@query(
    f"""WITH {D.MEMORIES}, hits AS (SELECT memory_id AS id, count(*) AS n FROM citations WHERE kind = 'error' AND memory_id // 250 % 4 = 1 GROUP BY 1),
    u AS (SELECT * FROM memories UNION ALL BY NAME SELECT id + 5000000 AS id, * EXCLUDE (id) FROM memories WHERE id % 50 = 7)
    SELECT u.id, CASE WHEN u.type = 'event' AND u.id // 250 % 4 = 1 THEN 'archived' ELSE status END AS status,
        recall_count + coalesce(n, 0) AS recall_count, round(CASE WHEN n IS NULL THEN importance ELSE least(1.0::DOUBLE, importance + 0.01::DOUBLE * n) END, 6) AS importance
    FROM u LEFT JOIN hits ON hits.id = u.id"""
)
def stored_changes(spark, d):
    """The table after recalls, changes of status and new rows, each a commit that writes the parts it touches."""
    rows = M.memories(spark, d)
    store = Store.create(rows, f"{scratch_root(spark)}/store-{uuid.uuid4().hex}", 250)
    few = F.col("id") % 1000 >= 250
    few = few & (F.col("id") % 1000 < 500)
    hits = M.citations(spark, d).where("kind = 'error'").select(F.col("memory_id").alias("id")).where(few)
    store.change(hits, mutations.recalled)
    store.change(rows.where("type = 'event'").where(few).select("id", F.lit("archived").alias("new_status")), mutations.with_status)
    store.append(rows.where("id % 50 = 7").withColumn("id", F.col("id") + 5_000_000))
    return store.read().select("id", "status", "recall_count", F.round("importance", 6).alias("importance"))


_NOT_SKIPPED = lambda m: f"NOT (trim({m}) = '' OR (NOT {D.any_of(f'trim({m})', *P.FORCE_SAVE_PATTERNS)} AND {D.any_of(f'trim({m})', *P.SKIP_PATTERNS)}))"


@query(
    f"""WITH {D.TURNS}, s AS (
        SELECT session_id, turn, 'user' AS role, {D.category('user_message')} AS type, trim(user_message)[1:500] AS text FROM turns WHERE {_NOT_SKIPPED('user_message')}
        UNION ALL SELECT session_id, turn, 'assistant', 'fact', trim(assistant_response)[1:500] FROM turns WHERE {_NOT_SKIPPED('assistant_response')}),
    e AS (SELECT *, {D.importance_steps('text', 'type')} AS importance, {D.attribute('text')} AS attribute FROM s),
    f AS (SELECT *, CASE WHEN attribute <> '' THEN 'user' ELSE '' END AS entity FROM e)
    SELECT session_id, turn, role, type, text, importance, entity, attribute, {D.prefix('type', 'entity', 'attribute', 'session_id')} AS context_prefix,
        '{{"source":"' || role || '","extraction_method":"sync","origin_session_id":"' || session_id || '"}}' AS metadata FROM f"""
)
def sync_stored(spark, d):
    """What turns leave in the store, read back from it."""
    made = context.stored_turns(M.turns(spark, d))
    rows = made.withColumn("id", F.xxhash64("session_id", "turn", "role")).withColumn("status", F.lit("active"))
    store = Store.create(rows, f"{scratch_root(spark)}/store-{uuid.uuid4().hex}", 2**60)
    return store.read("active").drop("id", "status")


_PLATFORMS = ", ".join(f"CASE WHEN {D.has('said', p)} THEN {D.lit(n)} END" for p, n in P.NOTED_PLATFORMS)
_TOOLS = ", ".join(f"CASE WHEN contains(said, '{t}') THEN '- Uses: {t}' END" for t in (*P.TECHNOLOGIES, "tion"))
_FRAME = [D.lit(x) for x in P.NOTES_FRAME]


@query(
    f"""WITH {D.TURNS}, l AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 50),
    s AS (SELECT session_id, lower(string_agg(user_message, ' ' ORDER BY turn)) AS said FROM l GROUP BY 1),
    n AS (SELECT session_id, array_to_string(list_concat(list_filter([{_PLATFORMS}], lambda x: x IS NOT NULL), list_concat(
        list_transform(regexp_extract_all(said, {D.lit(P.NOTED_PROJECT)}), lambda p: '- Project: ' || p), list_filter([{_TOOLS}], lambda x: x IS NOT NULL))), chr(10)) AS notes FROM s)
    SELECT session_id, CASE WHEN notes = '' THEN {D.lit(P.NO_NOTES)} ELSE {_FRAME[0]} || notes || {_FRAME[1]} || notes || {_FRAME[2]} END AS answer FROM n"""
)
def compression_answers(spark, d):
    """The notes of each session; a syllable stands in for a product's name."""
    return context.compression_answer(M.turns(spark, d), products=("tion",))


@query(
    """WITH p AS (SELECT page_id, k, url, trim(replace(replace(substring(coalesce(html, ''), 1, 400 * k), '<', ' '), '>', ' ')) AS s FROM pages, (SELECT unnest([1, 3]) AS k) WHERE url IS NOT NULL)
    SELECT page_id, 'T&' || k || ' ' || page_id AS title, url,
        replace(replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')[1:300] AS snippet FROM p"""
)
def result_page_links(spark, d):
    """Links of result pages made of the pages: an advertisement between two results, redirects, entities, markup in titles."""
    pages = M.table(spark, d, "pages").where("url IS NOT NULL")
    bare = lambda k: F.translate(F.substring(F.coalesce("html", F.lit("")), 1, 400 * k), "<>", "  ")
    link = lambda k, to: F.concat(
        F.lit(f'<a rel="nofollow" href="{to}'), F.url_encode("url"), F.lit(f"&rut={k}\" class='result-link'>T&amp;{k} <b>"), F.col("page_id").cast("string"),
        F.lit("</b></a><td class='result-snippet'>"), bare(k), F.lit("</td>"),
    )
    page = F.concat(link(1, "//duckduckgo.com/l/?uddg="), link(2, "//duckduckgo.com/y.js?u="), link(3, "//duckduckgo.com/l/?uddg="))
    return pages.select("page_id", F.explode(context.result_links(page)).alias("r")).select("page_id", "r.title", "r.url", "r.snippet")
