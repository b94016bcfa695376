"""All queries of the memory engine and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import patterns as P
from recollect.functions import scoring as S
from recollect.functions import text as X
from recollect.operators import context, graph, maintenance, mutations, retrieval
from recollect.plans import duck as D
from recollect.sources import memories as M
from recollect.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "hybrid_search"

#: Thresholds that the fixtures' vectors reach; the operators' defaults are for real embeddings.
DUPLICATE, CONTRADICTION, CONSOLIDATION = 0.40, 0.35, 0.30

#: Every query vector: ids divisible by 20, against all rows.
QUERY_STEP = 20


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _day(name: str) -> F.Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


DAY = lambda name: f"strftime({name}, '%Y-%m-%d') AS {name}"

# --- sources, filters, sorts -------------------------------------------------


@query(f"WITH {D.ENRICHED} SELECT id, type, importance, entity, attribute, context_prefix FROM enriched")
def enrichment(spark, d):
    return M.enrich(M.statements(spark, d)).select("id", "type", "importance", "entity", "attribute", "context_prefix")


@query(f"WITH {D.ENRICHED} SELECT id, type, CAST(length(text) AS INT) AS chars FROM enriched WHERE length(text) BETWEEN 1 AND 10000")
def store_validation(spark, d):
    return M.valid_for_store(M.enrich(M.statements(spark, d))).select("id", "type", F.length("text").alias("chars"))


@query(
    """SELECT doc_id AS id, text, CASE WHEN lang IN ('en') THEN 'fact' ELSE 'fact' END AS type FROM documents WHERE text IS NOT NULL AND text <> ''"""
)
def import_rows(spark, d):
    return M.imported(M.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("type")))


@query(f"WITH {D.MEMORIES} SELECT status, type, count(*) AS n, CAST(sum(count(*) FILTER (status = 'active')) OVER () AS BIGINT) AS active_total FROM memories GROUP BY status, type")
def stats_breakdown(spark, d):
    counts = M.memories(spark, d).groupBy("status", "type").agg(F.count("*").alias("n"))
    # a window over a row per status and type
    return counts.withColumn("active_total", F.expr("sum(CASE WHEN status = 'active' THEN n END) OVER ()"))


def _pages_sql(by: str) -> str:
    """The second page of 20 after 5 rows of every ``by``, newest first, with its total."""
    return f"""WITH {D.MEMORIES}, s AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY created_at DESC, id) AS place, count(*) OVER (PARTITION BY {by}) AS total
        FROM memories WHERE status = 'active') SELECT {by}, id, place, total FROM s WHERE place BETWEEN 6 AND 25"""


@query(_pages_sql("session_id"))
def session_pages(spark, d):
    return retrieval.pages(M.memories(spark, d), "session_id", 5, 20)


@query(_pages_sql("type"))
def type_pages(spark, d):
    return retrieval.pages(M.memories(spark, d), "type", 5, 20)


@query(f"WITH {D.MEMORIES} SELECT id, {DAY('valid_until')} FROM memories WHERE status = 'active' AND (valid_until IS NULL OR valid_until > {D.NOW})")
def temporal_validity(spark, d):
    return graph.valid(M.memories(spark, d).where("status = 'active'"), M.as_of()).select("id", _day("valid_until"))


@query(f"WITH {D.MEMORIES} SELECT id, {DAY('created_at')} FROM memories WHERE status = 'active' AND text ILIKE '%tion the%' ORDER BY memories.created_at DESC, id LIMIT 50")
def like_search(spark, d):
    return retrieval.like_search(M.memories(spark, d), "tion the", 50).select("id", _day("created_at"))


@query(f"WITH {D.MEMORIES} SELECT id, importance, recall_count FROM memories WHERE status = 'active' ORDER BY importance DESC, recall_count DESC, created_at DESC, id LIMIT 50")
def top_important(spark, d):
    order = [F.col(c).desc() for c in ("importance", "recall_count", "created_at")]
    return M.memories(spark, d).where("status = 'active'").orderBy(*order, "id").limit(50).select("id", "importance", "recall_count")


@query(f"WITH {D.MEMORIES} SELECT id FROM memories WHERE created_at < {D.NOW} - to_days(30)")
def session_before(spark, d):
    return M.memories(spark, d).where(F.col("created_at") < M.as_of() - F.make_dt_interval(F.lit(30))).select("id")


@query(f"WITH {D.MEMORIES} SELECT m.id FROM memories m LEFT JOIN embeddings e ON m.id = e.vec_id WHERE e.vec_id IS NULL AND status = 'active'")
def missing_vectors(spark, d):
    return M.memories(spark, d).where("status = 'active'").join(M.vectors(spark, d), "id", "left_anti").select("id")


# --- retrieval ---------------------------------------------------------------

QUERY_TEXTS = """
    queries AS (SELECT item_id AS query_id, text FROM benchmark),
    asked AS (SELECT * FROM queries WHERE text <> '')"""
BM25 = rf"""{QUERY_TEXTS},
    words AS (SELECT id, status, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}_]+') AS ws FROM memories),
    corpus AS (SELECT count(*) AS n, avg(len(ws)) AS avg_len FROM words),
    tf AS (SELECT id, status, len(ws) AS len, t.term, count(*) AS tf FROM words, unnest(ws) AS t(term) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    wanted AS (SELECT DISTINCT query_id, u.term FROM asked, unnest(string_split(lower({D.terms('strip_accents(text)')}), ' ')) AS u(term) WHERE u.term <> ''),
    n_terms AS (SELECT query_id, count(*) AS n_terms FROM wanted GROUP BY 1),
    part AS (SELECT query_id, id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS part
        FROM tf JOIN df USING (term) JOIN wanted USING (term), corpus WHERE status = 'active'),
    hit AS (SELECT query_id, id, sum(part) AS bm25 FROM part GROUP BY 1, 2 HAVING count(*) = (SELECT n_terms FROM n_terms x WHERE x.query_id = part.query_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) AS rank FROM hit)"""


#: Rows with some of the words rank too.
ANY = BM25.replace(" HAVING count(*) = (SELECT n_terms FROM n_terms x WHERE x.query_id = part.query_id)", "")


def _asked(spark, d) -> DataFrame:
    """The whole text of each benchmark item."""
    return M.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").where("text <> ''")


_TOP = f"""top AS (SELECT *, min(bm25) OVER w AS lo, max(bm25) OVER w AS hi FROM ranked WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, id, round(bm25, 6) AS bm25, {D.rounded('CASE WHEN lo = hi THEN 1.0::DOUBLE ELSE 0.3::DOUBLE + 0.7::DOUBLE * (bm25 - lo) / (hi - lo) END', 3)} AS score, CAST(rank AS INT) AS rank FROM top"""


@query(f"WITH {D.MEMORIES}, {ANY}, {_TOP}")
def bm25_search(spark, d):
    """Rows that say some of what a whole item says."""
    found = retrieval.keyword_hits(M.text_index(spark, d), M.memories(spark, d), _asked(spark, d), 10)
    return found.select("query_id", "id", F.round("bm25", 6).alias("bm25"), "score", "rank")


@query(f"WITH {D.MEMORIES}, {BM25}, {_TOP}")
def all_terms_search(spark, d):
    """Rows that say all of it."""
    found = retrieval.keyword_hits(M.text_index(spark, d), M.memories(spark, d), _asked(spark, d), 10, "all")
    return found.select("query_id", "id", F.round("bm25", 6).alias("bm25"), "score", "rank")


KNN = f"""{D.VECTORS},
    sims AS (SELECT q.id AS query_id, r.id AS id, {D.cosine('q.v', 'r.v')} AS c FROM vectors q, vectors r WHERE q.id % {QUERY_STEP} = 0 AND q.id <> r.id),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM sims)"""


@query(f"WITH {KNN} SELECT query_id, id, greatest(0.0::DOUBLE, {D.rounded('c', 3)}) AS score, CAST(rank AS INT) AS rank FROM near WHERE rank <= 10")
def knn_search(spark, d):
    v = M.vectors(spark, d)
    return retrieval.knn(v.where(F.col("id") % QUERY_STEP == 0), v, 10)


def _hybrid(session: str = "") -> str:
    """Common table expressions up to the fused list g (query_id, id, rrf, place)."""
    words = ANY.replace("WHERE status = 'active'", "WHERE status = 'active' AND (SELECT session_id FROM memories m WHERE m.id = tf.id) = (SELECT session_id FROM scopes s WHERE s.query_id = wanted.query_id)") if session else ANY
    near = "JOIN scopes s ON s.query_id = asked.query_id AND s.session_id = m.session_id" if session else ""
    return f"""{D.MEMORIES}, {session}{words}, {D.VECTORS},
    kind AS (SELECT query_id, {D.intent('text')} AS intent FROM asked),
    sims AS (SELECT q.id AS query_id, r.id AS id, {D.cosine('q.v', 'r.v')} AS c FROM vectors q JOIN asked ON q.id = query_id, vectors r JOIN memories m ON r.id = m.id AND m.status = 'active' {near} WHERE q.id <> r.id),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM sims WHERE c > 0.0),
    lists AS (
        SELECT query_id, id, 0 AS list, rank, CASE intent WHEN 'identifier' THEN 0.15 WHEN 'exact' THEN 0.3 WHEN 'conceptual' THEN 0.7 ELSE 0.45 END::DOUBLE / (60 + rank) AS part FROM near JOIN kind USING (query_id) WHERE rank <= 30
        UNION ALL SELECT query_id, id, 1, rank, CASE intent WHEN 'identifier' THEN 0.85 WHEN 'exact' THEN 0.7 WHEN 'conceptual' THEN 0.3 ELSE 0.55 END::DOUBLE / (60 + rank) FROM ranked JOIN kind USING (query_id) WHERE rank <= 30),
    f AS (SELECT query_id, id, sum(part) AS rrf, min((list, rank)) AS first FROM lists GROUP BY 1, 2),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first, id) AS place FROM f)"""


@query(f"WITH {_hybrid()} SELECT query_id, id, round(rrf, 9) AS rrf, {D.rounded('rrf', 3)} AS score, CAST(place AS INT) AS rank FROM g WHERE place <= 10")
def hybrid_search(spark, d):
    asked, v = _asked(spark, d), M.vectors(spark, d)
    own = v.join(asked.select(F.col("query_id").alias("id")), "id", "left_semi")
    found = retrieval.hybrid(M.text_index(spark, d), M.memories(spark, d), v, asked, own, 10)
    return found.select("query_id", "id", F.round("rrf", 9).alias("rrf"), "score", "rank")


_SCOPES = """scopes AS (SELECT item_id AS query_id, (SELECT source FROM documents WHERE doc_id = item_id) AS session_id FROM benchmark),"""


@query(
    f"""WITH {_hybrid(_SCOPES)}, d AS (SELECT query_id, id, rrf, {D.decayed('rrf')} AS decayed FROM g JOIN memories USING (id) WHERE place <= 30)
    SELECT query_id, id, round(rrf, 9) AS rrf, decayed, CAST(row_number() OVER (PARTITION BY query_id ORDER BY decayed DESC, round(rrf, 12) DESC, id) AS INT) AS rank FROM d QUALIFY rank <= 10"""
)
def hybrid_in_session(spark, d):
    """Hybrid search within the session of the row with the item's number, ranked by what has decayed least."""
    rows, v = M.memories(spark, d), M.vectors(spark, d)
    asked = _asked(spark, d).join(rows.select(F.col("id").alias("query_id"), "session_id"), "query_id")
    own = v.join(asked.select(F.col("query_id").alias("id")), "id", "left_semi")
    found = retrieval.hybrid(M.text_index(spark, d), rows, v, asked, own, 10, M.as_of(), rerank=True)
    return found.select("query_id", "id", F.round("rrf", 9).alias("rrf"), "decayed", "rank")


@query()
def mmr_rerank(spark, d):
    v = M.vectors(spark, d)
    hits = retrieval.knn(v.where(F.col("id") % QUERY_STEP == 0), v, 20, 0.0)
    return retrieval.mmr(hits, v, 5, 0.5)


@query(f"WITH {D.MEMORIES} SELECT id, {D.intent('text')} AS intent FROM memories")
def query_intent(spark, d):
    return M.memories(spark, d).select("id", X.intent(F.col("text")).alias("intent"))


@query(f"WITH {D.MEMORIES} SELECT id, {D.decayed('importance')} AS decayed FROM memories")
def decay_scores(spark, d):
    return retrieval.decay(M.memories(spark, d), M.as_of()).select("id", "decayed")


@query(
    """WITH s AS (SELECT vec_id AS id, list_filter(embedding, lambda x, i: (i - 1) % greatest(1, len(embedding) // 32) = 0) AS v FROM embeddings)
    SELECT id, CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(v, lambda x: CAST(((floor(x::DOUBLE * 10000 + 0.5)::BIGINT % 256) + 256) % 256 AS HUGEINT))),
        lambda h, x: (xor(h::BIGINT, x::BIGINT)::HUGEINT * 16777619) % 4294967296) AS BIGINT) AS hash FROM s"""
)
def vector_hash(spark, d):
    return M.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), S.vector_hash(F.col("embedding")).alias("hash"))


@query(f"SELECT item_id AS id, {D.terms('text')} AS terms FROM benchmark UNION ALL SELECT doc_id, {D.terms('text')} FROM documents")
def search_terms(spark, d):
    both = M.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text").union(M.table(spark, d, "documents").select("doc_id", "text"))
    return both.select("id", X.search_terms(F.col("text")).alias("terms"))


# --- maintenance -------------------------------------------------------------

PAIRS = f"{D.VECTORS}, pairs AS (SELECT a.id AS i, b.id AS j, {D.cosine('a.v', 'b.v')} AS c FROM vectors a, vectors b WHERE a.id < b.id)"


@query(f"WITH {PAIRS} SELECT i AS id, min(j) AS superseded_by FROM pairs WHERE c > {DUPLICATE} GROUP BY i")
def dedup_exact(spark, d):
    return maintenance.duplicates(M.vectors(spark, d), DUPLICATE)


@query(
    f"""WITH {D.VECTORS}, sims AS (SELECT a.id AS i, b.id AS j, {D.cosine('a.v', 'b.v')} AS c FROM vectors a, vectors b WHERE a.id <> b.id),
    n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY c DESC, j) AS rank FROM sims WHERE c > 0.0),
    k AS (SELECT *, {D.rounded('c', 3)} AS s FROM n WHERE rank <= 20)
    SELECT i AS id, arg_min(j, rank) AS superseded_by, arg_min(s, rank) AS score FROM k WHERE s > {DUPLICATE} AND j > i GROUP BY i"""
)
def dedup_knn(spark, d):
    return maintenance.duplicates_by_neighbours(M.vectors(spark, d), DUPLICATE)


@query(f"WITH {PAIRS} SELECT DISTINCT i AS id FROM pairs WHERE c > {DUPLICATE}")
def dedup_mark(spark, d):
    return maintenance.marked_invalid(M.vectors(spark, d), DUPLICATE)


_SAYS = ", ".join(f"{D.value_case('text', x)} AS {x}" for x in ("value", "negated", "past", "replaced"))
_NEXT = ", ".join(f"lead({x}) OVER w AS n_{x}" for x in ("id", "value", "negated", "past", "replaced"))
CONTRADICTIONS = f"""
    says AS (SELECT id, entity, attribute, {_SAYS} FROM memories WHERE status = 'active' AND entity <> '' AND attribute <> ''),
    adjacent AS (SELECT *, {_NEXT} FROM says WINDOW w AS (PARTITION BY entity, attribute ORDER BY id)),
    judged AS (SELECT id, n_id AS superseded_by, CASE WHEN value IS NULL OR n_value IS NULL THEN NULL
        WHEN value <> n_value AND NOT negated AND NOT n_negated THEN 'preference_change' WHEN value = n_value AND negated <> n_negated THEN 'negation_flip'
        WHEN past AND NOT n_past THEN 'temporal_update' WHEN value = n_replaced THEN 'state_change' END AS reason FROM adjacent WHERE n_id IS NOT NULL)"""


@query(f"WITH {D.MEMORIES}, {CONTRADICTIONS} SELECT * FROM judged WHERE reason IS NOT NULL")
def contradictions(spark, d):
    return maintenance.contradictions(M.memories(spark, d))


@query(f"WITH {D.MEMORIES} SELECT id, {_SAYS} FROM memories")
def stated_values(spark, d):
    return M.memories(spark, d).select("id", X.stated_value(F.col("text")).alias("s")).select("id", "s.*")


@query(
    f"""WITH {D.MEMORIES}, {PAIRS}, says AS (SELECT id, regexp_matches(lower(text), 'prefer|like|love|hate|dislike|favorite|use |using ') AS s FROM memories WHERE type <> 'general')
    SELECT i, j, round(c, 6) AS cosine FROM pairs JOIN says a ON a.id = i JOIN says b ON b.id = j WHERE c > {CONTRADICTION} AND (a.s OR b.s)"""
)
def contradicting_pairs(spark, d):
    found = maintenance.contradicting_pairs(M.memories(spark, d), M.vectors(spark, d), CONTRADICTION)
    return found.select("i", "j", F.round("cosine", 6).alias("cosine"))


@query(
    f"""WITH {D.MEMORIES}, c AS (SELECT id, {D.group('lower(text)', P.CONFLICT_VERB, 1)} AS said FROM memories WHERE entity = 'user' AND attribute = 'prefer_the' AND status = 'active')
    SELECT id FROM c WHERE said <> '' AND said <> 'light'"""
)
def conflict_check(spark, d):
    return maintenance.conflicts(M.memories(spark, d), "user", "prefer_the", "I prefer light mode").select("id")


_AGAIN = f"""again AS (SELECT id, type AS old_type, {D.category('text')} AS c FROM memories WHERE status = 'active' AND type IN ('general', 'fact')),
    fixable AS (SELECT id, type AS old_type, {D.corrected('text', 'type')} AS r FROM memories WHERE status = 'active'),
    fixes AS (SELECT * FROM fixable WHERE r IS NOT NULL ORDER BY id LIMIT 25),
    changes AS (SELECT coalesce(a.id, f.id) AS id, coalesce(a.old_type, f.old_type) AS old_type, coalesce(r, c) AS new_type
        FROM (SELECT * FROM again WHERE c <> old_type AND c <> 'fact') a FULL JOIN fixes f ON a.id = f.id)"""


@query(f"WITH {D.MEMORIES}, {_AGAIN} SELECT * FROM changes")
def type_changes(spark, d):
    return maintenance.type_changes(M.memories(spark, d))


@query(f"WITH {D.MEMORIES} SELECT id FROM memories WHERE status = 'active' AND recall_count = 0 AND created_at < {D.NOW} - to_days(90)")
def archive_stale(spark, d):
    return maintenance.to_archive(M.memories(spark, d), M.as_of()).select("id")


@query(f"WITH {D.MEMORIES} SELECT id FROM memories WHERE status = 'active' AND recall_count = 0 AND created_at < {D.NOW} - to_days(365) AND importance < 0.3")
def purge_stale(spark, d):
    return maintenance.to_purge(M.memories(spark, d), M.as_of()).select("id")


@query(f"WITH {D.MEMORIES} SELECT id FROM memories WHERE status = 'active' AND compression_level < 2 AND created_at < {D.NOW} - to_days(60) ORDER BY created_at, id LIMIT 100")
def compressible(spark, d):
    return maintenance.to_compress(M.memories(spark, d), M.as_of(), 2, 60, 100).select("id")


CLUSTERS = f"""{PAIRS},
    low AS (SELECT id, entity FROM memories WHERE importance < 0.75 AND entity <> '' AND status = 'active'),
    linked AS (SELECT i, j FROM pairs JOIN low a ON a.id = i JOIN low b ON b.id = j WHERE c > {CONSOLIDATION} AND a.entity = b.entity),
    both_ways AS (SELECT i AS u, j AS v FROM linked UNION ALL SELECT j, i FROM linked),
    reach AS (SELECT DISTINCT u AS node, u AS seen FROM both_ways),
    cc AS (WITH RECURSIVE r(node, seen) AS (SELECT node, seen FROM reach UNION SELECT r.node, v FROM r JOIN both_ways ON u = r.seen) SELECT node, min(seen) AS cluster FROM r GROUP BY node),
    clustered AS (SELECT cluster, node AS id FROM cc QUALIFY count(*) OVER (PARTITION BY cluster) >= 3)"""


@query(f"WITH {D.MEMORIES}, {CLUSTERS} SELECT cluster, id FROM clustered")
def consolidation_clusters(spark, d):
    return maintenance.clusters(M.memories(spark, d), M.vectors(spark, d), CONSOLIDATION, 0.75)


_PRIORITY = "list_position([" + ", ".join(map(D.lit, P.TYPE_PRIORITY)) + "], type)"


@query(
    f"""WITH {D.MEMORIES}, {CLUSTERS}, m AS (SELECT cluster, memories.*, least(coalesce({_PRIORITY}, 0), 10) AS r FROM clustered JOIN memories USING (id)),
    h AS (SELECT cluster, CASE WHEN min(r) = 10 THEN 'fact' ELSE min((r, type))[2] END AS type, least(1.0::DOUBLE, max(importance) + 0.2::DOUBLE) AS importance,
        'Consolidated ' || count(*) || ' memories about ' || min(entity) || ':' AS context_prefix FROM m GROUP BY cluster),
    p AS (SELECT cluster, id, text, created_at, coalesce(sum(length(text) + 3) OVER (PARTITION BY cluster ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 16000000 AS part FROM m)
    SELECT cluster, CAST(part AS BIGINT) AS part, string_agg(text, ' | ' ORDER BY created_at, id) AS text, any_value(type) AS type, any_value(importance) AS importance,
        array_to_string(list(id ORDER BY id), ',') AS sources, any_value(context_prefix) AS context_prefix FROM p JOIN h USING (cluster) GROUP BY cluster, part"""
)
def consolidation_summaries(spark, d):
    rows = M.memories(spark, d)
    made = maintenance.summaries(rows, maintenance.clusters(rows, M.vectors(spark, d), CONSOLIDATION, 0.75))
    sources = F.array_join(F.transform("source_memory_ids", lambda x: x.cast("string")), ",").alias("sources")
    return made.select("cluster", "part", "text", "type", "importance", sources, "context_prefix")


@query(
    f"""WITH {D.MEMORIES}, {CONTRADICTIONS}, {_AGAIN}, {CLUSTERS},
    own AS (SELECT vectors.* FROM vectors JOIN memories USING (id) WHERE status = 'active'),
    copies AS (SELECT a.id, min(b.id) AS by_ FROM own a, own b WHERE a.id < b.id AND {D.cosine('a.v', 'b.v')} > {DUPLICATE} GROUP BY a.id),
    clash AS (SELECT id, superseded_by AS clash FROM judged WHERE reason IS NOT NULL),
    summed AS (SELECT (SELECT max(id) FROM memories) + 1 + cluster AS new_id, id FROM clustered),
    named AS (SELECT new_id, min((least(coalesce({_PRIORITY}, 0), 10), type)) AS best FROM summed JOIN memories USING (id) GROUP BY new_id),
    joined AS (SELECT m.id, m.status, m.superseded_by AS was, m.type, coalesce(new_id, clash, by_) AS b, new_type,
        m.status = 'active' AND recall_count = 0 AND created_at < {D.NOW} - to_days(90) AS old
        FROM memories m LEFT JOIN copies USING (id) LEFT JOIN clash USING (id) LEFT JOIN summed USING (id)
        LEFT JOIN (SELECT id, new_type FROM changes) USING (id) WHERE status <> 'invalid')
    SELECT id, CASE WHEN b IS NOT NULL THEN 'superseded' WHEN old THEN 'archived' ELSE status END AS status, coalesce(b, was) AS superseded_by, coalesce(new_type, type) AS type FROM joined
    UNION ALL SELECT new_id, 'active', NULL, CASE WHEN best[1] = 10 THEN 'fact' ELSE best[2] END FROM named"""
)
def maintenance_run(spark, d):
    return maintenance.next_state(M.memories(spark, d), M.vectors(spark, d), M.as_of(), DUPLICATE, CONSOLIDATION, 0.75)


# --- graph and provenance ----------------------------------------------------

WALK = f"""{D.EDGES}, open_edges AS (SELECT * FROM edges WHERE valid_until IS NULL OR valid_until > {D.NOW}),
    walk AS (WITH RECURSIVE g(start, node, depth, path) AS (
        SELECT s_suppkey + {M.SUPPLIER}, s_suppkey + {M.SUPPLIER}, 0, CAST(s_suppkey + {M.SUPPLIER} AS VARCHAR) FROM supplier
        UNION ALL SELECT g.start, e.to_id, g.depth + 1, g.path || '-' || e.relation || '->' || e.to_id FROM g JOIN open_edges e ON e.from_id = g.node WHERE g.depth < 5) SELECT * FROM g)"""


@query(f"WITH {WALK} SELECT start, node AS to_id, depth, path FROM walk WHERE depth > 0")
def graph_traverse(spark, d):
    starts = M.table(spark, d, "supplier").select((F.col("s_suppkey") + M.SUPPLIER).alias("start"))
    return graph.traverse(M.edges(spark, d), starts, M.as_of())


_REACH = f"""{D.EDGES}, open_edges AS (SELECT * FROM edges WHERE valid_until IS NULL OR valid_until > {D.NOW}),
    walk AS (WITH RECURSIVE g(start, node, depth, parent, relation) AS (
        SELECT DISTINCT from_id, from_id, 0, NULL::BIGINT, NULL::VARCHAR FROM edges
        UNION ALL SELECT DISTINCT g.start, e.to_id, g.depth + 1, g.node, e.relation FROM g JOIN open_edges e ON e.from_id = g.node WHERE g.depth < 4) SELECT * FROM g),
    tree AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY depth, parent, relation) = 1),
    way AS (WITH RECURSIVE p(start, node, depth, path) AS (
        SELECT start, node, 0, CAST(node AS VARCHAR) FROM tree WHERE depth = 0
        UNION ALL SELECT t.start, t.node, t.depth, p.path || '-' || t.relation || '->' || t.node FROM p JOIN tree t ON t.start = p.start AND t.parent = p.node AND t.depth = p.depth + 1) SELECT * FROM p)"""


@query(f"WITH {_REACH} SELECT start, node, depth, parent, relation FROM tree")
def graph_reached(spark, d):
    """What each node of the graph reaches within four steps, each node once."""
    edges = M.edges(spark, d)
    return graph.reached(edges, edges.select(F.col("from_id").alias("start")), M.as_of(), 4)


@query(f"WITH {_REACH} SELECT start, node, depth, path FROM way")
def graph_paths(spark, d):
    """The ways there."""
    edges = M.edges(spark, d)
    return graph.paths(graph.reached(edges, edges.select(F.col("from_id").alias("start")), M.as_of(), 4))


@query(
    f"""WITH {D.EDGES}, open_edges AS (SELECT * FROM edges WHERE valid_until IS NULL OR valid_until > {D.NOW}), nodes AS (SELECT n_nationkey + {M.NATION} AS node FROM nation)
    SELECT CAST(node AS BIGINT) AS node, to_id AS other, relation, strength, 'out' AS direction FROM open_edges JOIN nodes ON from_id = node
    UNION ALL SELECT node, from_id, relation, strength, 'in' FROM open_edges JOIN nodes ON to_id = node"""
)
def graph_neighbours(spark, d):
    nodes = M.table(spark, d, "nation").select((F.col("n_nationkey") + M.NATION).cast("long").alias("node"))
    return graph.neighbours(M.edges(spark, d), nodes, M.as_of())


@query(f"WITH {D.EDGES} SELECT id, from_id, to_id, relation, strength, {DAY('valid_until')} FROM edges ORDER BY strength DESC, id LIMIT 100")
def edges_by_strength(spark, d):
    rows = M.edges(spark, d).orderBy(F.col("strength").desc(), "id").limit(100)
    return rows.select("id", "from_id", "to_id", "relation", "strength", _day("valid_until"))


@query(
    f"""WITH {D.MEMORIES}, l AS (WITH RECURSIVE c(id, node, steps) AS (
        SELECT id, id, 0 FROM memories WHERE superseded_by IN (SELECT id FROM memories)
        UNION ALL SELECT c.id, m.superseded_by, steps + 1 FROM c JOIN memories m ON m.id = c.node WHERE m.superseded_by IN (SELECT id FROM memories) AND steps < 50) SELECT * FROM c),
    e AS (SELECT id, arg_max(node, steps) AS last, max(steps) AS steps FROM l GROUP BY id)
    SELECT e.id, e.last, CAST(e.steps AS INT) AS steps, m.superseded_by IS NOT NULL AND m.superseded_by IN (SELECT id FROM memories) AS truncated FROM e JOIN memories m ON m.id = e.last"""
)
def lineage(spark, d):
    return graph.lineage(M.memories(spark, d, "id", "superseded_by"))


@query(
    f"""WITH {D.MEMORIES}, l AS (SELECT id AS from_id, lag(id) OVER (PARTITION BY entity, attribute ORDER BY id) AS to_id FROM memories WHERE status = 'active' AND entity <> '' AND attribute <> '')
    SELECT from_id, to_id, 'same_entity' AS relation, 0.5::DOUBLE AS strength FROM l WHERE to_id IS NOT NULL"""
)
def same_entity_edges(spark, d):
    return graph.same_entity_edges(M.memories(spark, d))


_EDGE_ROWS = " UNION ALL ".join(
    f"SELECT id, '{r}' AS relation, {D.sub(f'trim({D.group("text", "(?i)" + p, g)})', r'[.!?,;]+$', '')} AS object FROM memories WHERE {D.has('text', '(?i)' + p)}"
    for p, r, g in P.EDGE_PATTERNS
)
RELATIONS = f"relations AS (SELECT DISTINCT * FROM ({_EDGE_ROWS}) WHERE length(object) >= 2)"


@query(f"WITH {D.MEMORIES}, {RELATIONS} SELECT * FROM relations")
def stated_relations(spark, d):
    return graph.stated_relations(M.memories(spark, d))


_LINKED = BM25[len(QUERY_TEXTS) :]


@query(
    f"""WITH {D.MEMORIES}, {RELATIONS}, said AS (SELECT r.* FROM relations r JOIN memories m ON m.id = r.id AND m.status = 'active'),
    asked AS (SELECT DISTINCT object AS query_id, object AS text FROM said){_LINKED},
    l AS (SELECT s.id AS from_id, b.id AS to_id, relation FROM said s JOIN ranked b ON b.query_id = s.object WHERE b.rank <= 2 AND b.id <> s.id
        QUALIFY row_number() OVER (PARTITION BY s.id, relation, s.object ORDER BY b.rank) = 1)
    SELECT * FROM l"""
)
def edges_by_text(spark, d):
    return graph.linked_by_text(M.memories(spark, d, "id", "text", "status"))


# --- aggregates and mutations ------------------------------------------------


@query(f"WITH {D.CITATIONS} SELECT memory_id, count(*) AS n FROM citations WHERE cited_at >= {D.NOW} - to_days(30) GROUP BY 1")
def citations_per_memory(spark, d):
    rows = M.citations(spark, d).where(F.col("cited_at") >= M.as_of() - F.make_dt_interval(F.lit(30)))
    return rows.groupBy("memory_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {D.CITATIONS}, c AS (SELECT session, memory_id, count(*) AS n FROM citations GROUP BY 1, 2)
    SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY n DESC, memory_id) AS INT) AS rank FROM c QUALIFY rank <= 5"""
)
def top_cited(spark, d):
    counts = M.citations(spark, d).groupBy("session", "memory_id").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.expr("row_number() OVER (PARTITION BY session ORDER BY n DESC, memory_id)")).where("rank <= 5")


def _hits(spark, d, kind: str) -> DataFrame:
    return M.citations(spark, d).where(F.col("kind") == kind).select(F.col("memory_id").alias("id"))


@query(
    f"""WITH {D.MEMORIES}, h AS (SELECT memory_id AS id, count(*) AS n FROM citations WHERE kind = 'click' GROUP BY 1)
    SELECT id, recall_count + coalesce(n, 0) AS recall_count, round(CASE WHEN n > 0 THEN least(1.0::DOUBLE, importance + 0.01::DOUBLE * n) ELSE importance END, 6) AS importance FROM memories LEFT JOIN h USING (id)"""
)
def recall_increment(spark, d):
    after = mutations.recalled(M.memories(spark, d), _hits(spark, d, "click"))
    return after.select("id", "recall_count", F.round("importance", 6).alias("importance"))


@query(
    f"""WITH {D.MEMORIES}, h AS (SELECT memory_id AS id, count(*) AS n FROM citations WHERE kind = 'purchase' GROUP BY 1)
    SELECT id, CAST(use_count + CASE WHEN status = 'active' THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS use_count,
        round(CASE WHEN status = 'active' AND n > 0 THEN least(1.0::DOUBLE, importance + 0.03::DOUBLE * n) ELSE importance END, 6) AS importance FROM memories LEFT JOIN h USING (id)"""
)
def feedback_boost(spark, d):
    after = mutations.fed_back(M.memories(spark, d), _hits(spark, d, "purchase"))
    uses = F.get_json_object("metadata", "$.use_count").cast("long").alias("use_count")
    return after.select("id", uses, F.round("importance", 6).alias("importance"))


@query(
    f"""WITH {D.MEMORIES}, p AS (SELECT id AS old_id, id + 2 AS new_id FROM memories WHERE status = 'active' AND id + 2 IN (SELECT id FROM memories) AND type = 'preference')
    SELECT id, CASE WHEN o.new_id IS NOT NULL THEN 'superseded' ELSE status END AS status, coalesce(o.new_id, superseded_by) AS superseded_by,
        strftime(CASE WHEN o.new_id IS NOT NULL THEN {D.NOW} ELSE valid_until END, '%Y-%m-%d') AS valid_until,
        CASE WHEN n.old_id IS NOT NULL THEN '2024-01-31' END AS valid_from, coalesce(CAST(n.old_id AS VARCHAR), '') AS sources,
        CASE WHEN n.old_id IS NOT NULL THEN '{{"supersedes":' || n.old_id || ',"reason":"newer"}}' ELSE '{{"use_count":' || use_count || '}}' END AS metadata
    FROM memories LEFT JOIN p o ON o.old_id = id LEFT JOIN p n ON n.new_id = id"""
)
def supersede(spark, d):
    rows = M.memories(spark, d, "id", "type", "status", "superseded_by", "valid_until", "metadata").withColumn("valid_from", F.lit(None).cast("timestamp")).withColumn("source_memory_ids", F.lit(None).cast("array<bigint>"))
    ids = rows.select(F.col("id").alias("new_id"))
    pairs = rows.where("status = 'active' AND type = 'preference'").select(F.col("id").alias("old_id"), (F.col("id") + 2).alias("new_id"), F.lit("newer").alias("reason"))
    after = mutations.superseded(rows, pairs.join(ids, "new_id", "left_semi"), M.as_of())
    sources = F.coalesce(F.array_join(F.transform("source_memory_ids", lambda x: x.cast("string")), ","), F.lit("")).alias("sources")
    return after.select("id", "status", "superseded_by", _day("valid_until"), _day("valid_from"), sources, "metadata")


@query(f"WITH {D.MEMORIES} SELECT id, status FROM memories WHERE status <> 'invalid' OR id IN (SELECT superseded_by FROM memories)")
def delete_invalid(spark, d):
    rows = M.memories(spark, d)
    return mutations.without(rows, rows.where("status = 'invalid'").select("id")).select("id", "status")


@query(
    f"""WITH {D.EDGES}, n AS (SELECT from_id, to_id FROM edges WHERE relation = 'located_in' AND k2 = 0) SELECT from_id, to_id FROM n""".replace(" AND k2 = 0", " AND from_id % 2 = 0")
)
def edge_insert(spark, d):
    """New edges between suppliers and nations; those whose supplier isn't among the nodes are refused."""
    rows = M.edges(spark, d)
    nodes = rows.select(F.col("from_id").alias("id")).where("id % 2 = 0").union(rows.select(F.col("to_id").alias("id")))
    new = rows.where("relation = 'located_in'")
    return mutations.inserted_edges(rows.limit(0), new, nodes).select("from_id", "to_id")


@query(f"WITH {D.EDGES} SELECT id, strftime(CASE WHEN valid_until IS NULL AND id % 16 = 0 THEN {D.NOW} ELSE valid_until END, '%Y-%m-%d') AS valid_until FROM edges")
def edge_invalidate(spark, d):
    rows = M.edges(spark, d)
    return mutations.ended_edges(rows, rows.where("id % 16 = 0").select("id"), M.as_of()).select("id", _day("valid_until"))


@query(
    """WITH b AS (SELECT p_brand AS key, p_name AS value, p_partkey AS "at" FROM part UNION ALL SELECT p_brand, repeat(p_name, 30)[1:500], p_partkey + 1000000000 FROM part WHERE p_size > 25)
    SELECT key, arg_max(value, "at") AS value, max("at") AS "at" FROM b GROUP BY key"""
)
def core_block_upsert(spark, d):
    part = M.table(spark, d, "part")
    blocks = part.select(F.col("p_brand").alias("key"), F.col("p_name").alias("value"), F.col("p_partkey").alias("at"))
    writes = part.where("p_size > 25").select(F.col("p_brand").alias("key"), F.repeat("p_name", F.lit(30)).alias("value"), (F.col("p_partkey") + 1000000000).alias("at"))
    return mutations.upserted_blocks(blocks, writes)


# --- text rules --------------------------------------------------------------

_COLLAPSE = lambda x: f"trim({D.sub(D.sub(x, P.FILLERS, ''), r'\s+', ' ')})"
_SENTENCES = "list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: trim(s)), lambda s: s <> '')"
_KEY_WORDS = f"list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 3 AND NOT {D.has('w', f'(?i)^({P.COMPRESS_STOPWORDS})$')})"


@query(
    f"""WITH {D.STATEMENTS}, s AS (SELECT id, text, {_SENTENCES} AS ss FROM statements)
    SELECT id, CASE WHEN len(ss) = 0 THEN text ELSE array_to_string(list_filter(list_transform(ss[1:2], lambda x: {_COLLAPSE('x')}), lambda x: x <> ''), '. ') || '.' END AS level1,
        CASE WHEN len(ss) = 0 THEN text WHEN length({_COLLAPSE('ss[1]')}) > 100 THEN {_COLLAPSE('ss[1]')}[1:97] || '...' ELSE {_COLLAPSE('ss[1]')} || '.' END AS level2,
        CASE WHEN len(ss) = 0 THEN text ELSE array_to_string({_KEY_WORDS}[1:8], ' ') END AS level3 FROM s"""
)
def compression(spark, d):
    text = F.col("text")
    return M.statements(spark, d).select("id", *(X.compressed(text, n).alias(f"level{n}") for n in (1, 2, 3)))


@query(
    f"""WITH {D.MEMORIES}, s AS (SELECT id, text, compression_level AS l, {_SENTENCES} AS ss FROM memories)
    SELECT id, CASE WHEN l = 0 THEN text WHEN len(ss) = 0 THEN text WHEN length({_COLLAPSE('ss[1]')}) > 100 THEN {_COLLAPSE('ss[1]')}[1:97] || '...' ELSE {_COLLAPSE('ss[1]')} || '.' END AS text FROM s"""
)
def raw_lookup(spark, d):
    """All rows compressed to level 2; those that were at level 0 are read back from the raw texts."""
    rows = M.memories(spark, d)
    small, raw = mutations.compressed(rows, rows.select("id"), 2)
    return mutations.raw_text(small, raw)


_STOP = "[" + ", ".join(map(D.lit, P.KEYWORD_STOPWORDS.split())) + "]"


@query(f"WITH {D.STATEMENTS} SELECT id, array_to_string(list_filter(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]{{2,}}'), lambda w: NOT list_contains({_STOP}, lower(w)))[1:5], ' ') AS keywords FROM statements")
def keyword_extraction(spark, d):
    return M.statements(spark, d).select("id", F.array_join(X.keywords(F.col("text")), " ").alias("keywords"))


_SKIP = f"(trim(m) = '' OR (NOT {D.any_of('trim(m)', *P.FORCE_SAVE_PATTERNS)} AND {D.any_of('trim(m)', *P.SKIP_PATTERNS)}))"


@query(
    f"""WITH {D.TURNS}, t AS (SELECT *, user_message AS m FROM turns), k AS (SELECT * FROM t WHERE NOT {_SKIP})
    SELECT session_id, turn, 'user' AS role, {D.category('user_message')} AS type, user_message[1:500] AS text FROM k
    UNION ALL SELECT session_id, turn, 'assistant', 'fact', assistant_response[1:500] FROM k WHERE trim(assistant_response) <> ''"""
)
def sync_turns(spark, d):
    return context.synced(M.turns(spark, d))


@query(
    f"""WITH {D.TURNS} SELECT session_id, turn FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 2"""
)
def last_turns(spark, d):
    return context.last_turns(M.turns(spark, d), 2).select("session_id", "turn")


_BARE = f"trim({D.sub('low', r'[^a-z0-9\s]', '')})"


@query(
    f"""WITH {D.STATEMENTS}, l AS (SELECT id, lower(trim(text)) AS low FROM statements)
    SELECT id, length(low) < 10 OR {D.any_of('low', P.SMALL_TALK, *P.INFORMATION_PATTERNS, *P.ASSISTANT_PATTERNS)}
        OR (len(string_split_regex({_BARE}, '\\s+')) <= 2 AND length({_BARE}) < 15) AS skipped FROM l"""
)
def non_technical(spark, d):
    return M.statements(spark, d).select("id", X.is_non_technical(F.col("text")).alias("skipped"))


_TOPIC = "CASE " + " ".join(f"WHEN length(trim({D.group('text', p, g)})) >= 3 THEN trim({D.group('text', p, g)})" for p, g, _ in P.TOPIC_PATTERNS) + " END"
_TOPIC_KIND = "CASE " + " ".join(f"WHEN length(trim({D.group('text', p, g)})) >= 3 THEN '{k}'" for p, g, k in P.TOPIC_PATTERNS) + " END"


@query(
    f"""WITH {D.STATEMENTS}, t AS (SELECT id, {_TOPIC} AS topic, {_TOPIC_KIND} AS kind FROM statements
        WHERE NOT {D.any_of('lower(text)', *P.INFORMATION_PATTERNS, *P.ASSISTANT_PATTERNS, *P.PASSIVE_PATTERNS)})
    SELECT id, topic, kind, CASE kind WHEN 'build' THEN 'how to build ' || topic || ' 2024' WHEN 'fix' THEN 'how to fix ' || topic || ' 2024' WHEN 'error' THEN topic || ' fix' ELSE topic || ' 2024' END AS query,
        lower({D.sub('topic', r'\s+', '_')})[1:30] AS entity FROM t WHERE topic IS NOT NULL"""
)
def research_topics(spark, d):
    return M.statements(spark, d).select("id", X.research_topic(F.col("text"), 2024).alias("t")).where("t IS NOT NULL").select("id", "t.*")


_EXTRACT = " UNION ".join(
    f"SELECT id, '{label}' || m[1:200] AS text, '{kind}' AS type FROM (SELECT id, unnest(regexp_extract_all(text, {D.lit(p)})) AS m FROM statements)"
    for kind, label, ps in (("preference", "User prefers/mentions: ", P.EXTRACT_PREFERENCES), ("project", "User project mention: ", P.EXTRACT_PROJECTS))
    for p in ps
)


@query(f"WITH {D.STATEMENTS} {_EXTRACT}")
def extraction(spark, d):
    rows = M.statements(spark, d).select("id", F.explode(X.extracted(F.col("text"))).alias("m"))
    return rows.select("id", "m.text", "m.type")


_ENTITIES = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_DROPPED = "html"
for _tag in P.DROPPED_BLOCKS:
    _DROPPED = D.sub(_DROPPED, rf"(?is)<{_tag}[\s>].*?</{_tag}>", "")
_MAIN = r"(?is)<(?:main|article)[^>]*>(.*?)</(?:main|article)>"


@query(
    f"""WITH p AS (SELECT page_id, html, {_DROPPED} AS h FROM pages), b AS (SELECT page_id, html, CASE WHEN {D.has('h', _MAIN)} THEN {D.group('h', _MAIN, 1)} ELSE h END AS body FROM p)
    SELECT page_id, {_ENTITIES(f"trim({D.sub(D.group('html', r'(?is)<title[^>]*>(.*?)</title>', 1), r'<[^>]+>', '')})")}[1:200] AS title,
        trim({D.sub(_ENTITIES(D.sub('body', r'<[^>]+>', ' ')), r'\s+', ' ')}) AS text FROM b"""
)
def page_text(spark, d):
    html = F.col("html")
    return M.table(spark, d, "pages").select("page_id", X.page_title(html).alias("title"), X.page_text(html, None).alias("text"))


_URLS = """urls AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'http://10.0.0.' || page_id || '/x' WHEN 2 THEN url || '/file.PDF' WHEN 3 THEN 'ftp://example.com/a'
    WHEN 4 THEN '//duckduckgo.com/l/?uddg=https%3A%2F%2Fexample.com%2Fp%3Fq%3D' || page_id || '&rut=1' ELSE 'http://[::1]:8080/' END AS url FROM pages)"""


def _urls(spark, d) -> DataFrame:
    return M.table(spark, d, "pages").select(
        "page_id",
        F.expr(
            """CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'http://10.0.0.' || page_id || '/x' WHEN 2 THEN url || '/file.PDF' WHEN 3 THEN 'ftp://example.com/a'
            WHEN 4 THEN '//duckduckgo.com/l/?uddg=https%3A%2F%2Fexample.com%2Fp%3Fq%3D' || page_id || '&rut=1' ELSE 'http://[::1]:8080/' END"""
        ).alias("url"),
    )


@query(
    f"""WITH {_URLS} SELECT page_id, {D.has('lower(url)', r'^https?://[^/?#\s]+')} AND NOT {D.has(D.group('lower(url)', r'^https?://[^/?#]+([^?#]*)', 1), P.BINARY_SUFFIX)} AS fetchable,
        {D.group('url', r'(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]+)', 1)} = '' OR {D.has(D.sub(D.group('url', r'(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]+)', 1), r'[\[\]]', ''), P.PRIVATE_HOST)} AS private,
        CASE WHEN contains(url, 'uddg=') AND starts_with(url_decode(regexp_extract(url, 'uddg=([^&]*)', 1)), 'http') THEN url_decode(regexp_extract(url, 'uddg=([^&]*)', 1))
            WHEN starts_with(url, '//') THEN 'https:' || url ELSE url END AS target FROM urls"""
)
def url_rules(spark, d):
    url = F.col("url")
    return _urls(spark, d).select("page_id", X.is_fetchable(url).alias("fetchable"), X.is_private(url).alias("private"), X.redirect_target(url).alias("target"))


@query(
    f"""WITH {_URLS}, v AS (SELECT page_id, page_id // 16 AS query_id, CASE WHEN page_id % 7 = 3 THEN 'https://duckduckgo.com/y.js?ad=' || page_id ELSE url END AS url FROM urls),
    u AS (SELECT query_id, substr('aabllllllllllllll', CAST(page_id % 16 + 1 AS INT), 1) || page_id AS title, url, CASE WHEN page_id % 16 < 2 THEN 0 WHEN page_id % 16 = 2 THEN 1 ELSE 2 END AS place, page_id AS position FROM v),
    t AS (SELECT *, CASE WHEN contains(url, 'uddg=') THEN url_decode(regexp_extract(url, 'uddg=([^&]*)', 1)) WHEN starts_with(url, '//') THEN 'https:' || url ELSE url END AS target FROM u)
    SELECT query_id, title, target AS url, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, position) AS INT) AS rank FROM t WHERE NOT contains(target, 'duckduckgo.com/y.js') QUALIFY rank <= 10"""
)
def web_search_merge(spark, d):
    """Abstracts, an answer and links, among them advertisements, of searches with sixteen results."""
    ad = F.concat(F.lit("https://duckduckgo.com/y.js?ad="), F.col("page_id").cast("string"))
    rows = _urls(spark, d).withColumn("url", F.when(F.col("page_id") % 7 == 3, ad).otherwise(F.col("url"))).withColumn("k", F.col("page_id") % 16)
    part = lambda where, mark: rows.where(where).select(F.expr("page_id div 16").alias("query_id"), F.concat(F.lit(mark), F.col("page_id").cast("string")).alias("title"), "url", F.col("page_id").alias("position"))
    return context.merged_search(part("k < 2", "a"), part("k = 2", "b"), part("k > 2", "l"), 10)


# --- context, streams --------------------------------------------------------

RELEASE = f"""scored AS (SELECT *, {D.decayed('importance')} AS decayed FROM memories WHERE status = 'active'),
    once AS (SELECT * FROM scored QUALIFY entity = '' OR attribute = '' OR row_number() OVER (PARTITION BY session_id, entity, attribute ORDER BY decayed DESC, id) = 1),
    lines AS (SELECT session_id, id, decayed, '- (' || type || ') ' || CASE WHEN context_prefix <> '' THEN '[' || context_prefix || '] ' ELSE '' END || text AS line FROM once),
    used AS (SELECT *, CAST(sum(length(line)) OVER (PARTITION BY session_id ORDER BY decayed DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM lines)"""


@query(f"WITH {D.MEMORIES}, {RELEASE} SELECT session_id, id, line, used FROM used WHERE used <= 8000")
def release_context(spark, d):
    return context.release(M.memories(spark, d), M.as_of(), 2000)


@query(
    f"""WITH {D.MEMORIES}, {RELEASE},
    r AS (SELECT session_id, 0 AS place, 'context' AS source, id AS rank, id, line FROM used WHERE used <= 2000),
    e AS (SELECT session_id, 1 AS place, 'entity' AS source, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, id) AS rank, id, '- ' || text AS line FROM memories WHERE status = 'active' AND entity <> ''),
    a AS (SELECT * FROM (SELECT * FROM r UNION ALL SELECT * FROM e WHERE rank <= 5) QUALIFY row_number() OVER (PARTITION BY session_id, id ORDER BY place, rank) = 1),
    b AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY session_id ORDER BY place, rank, id ROWS UNBOUNDED PRECEDING) AS used FROM a)
    SELECT session_id, source, id, line FROM b WHERE used <= 3000"""
)
def recall_lines(spark, d):
    rows = M.memories(spark, d)
    first = context.release(rows, M.as_of(), 500).withColumn("rank", F.col("id"))
    place = F.expr("row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, id)")
    named = rows.where("status = 'active' AND entity <> ''").withColumn("rank", place).where("rank <= 5").withColumn("line", F.concat(F.lit("- "), "text"))
    return context.recall_lines([("context", first), ("entity", named)], 3000)


def _requests(spark, d) -> DataFrame:
    return M.table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))


@query(
    """WITH RECURSIVE n AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r(user_id, event_id, k, recent, kept) AS (
        SELECT user_id, event_id, k, 0::BIGINT, [us] FROM n WHERE k = 1
        UNION ALL SELECT n.user_id, n.event_id, n.k, len(list_filter(kept, lambda x: n.us - x <= 21600000000)),
            CASE WHEN len(list_filter(kept, lambda x: n.us - x <= 21600000000)) < 2 THEN list_append(list_filter(kept, lambda x: n.us - x <= 21600000000), n.us) ELSE list_filter(kept, lambda x: n.us - x <= 21600000000) END
        FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1)
    SELECT event_id AS id, recent, recent < 2 AS allowed FROM r"""
)
def fetch_limit(spark, d):
    return ingest.fetch_limited(_requests(spark, d), 6 * 3600, 2).select("id", "recent", "allowed")


@query("SELECT CAST(user_id AS VARCHAR) AS key, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events GROUP BY ALL")
def request_windows(spark, d):
    found = ingest.request_windows(_requests(spark, d), 3600)
    return found.select("key", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT CAST(user_id AS VARCHAR) AS key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_gaps(spark, d):
    found = ingest.sessions(_requests(spark, d), 3600)
    return found.select("key", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")), "n")


from recollect.plans import more  # noqa: E402, F401  registers its queries
