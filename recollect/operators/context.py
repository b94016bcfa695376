"""Context assembly: what fits a budget, best first; turns and recall lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import patterns as P
from recollect.functions import text as X
from recollect.operators.retrieval import decay
from recollect.sources.memories import enrich

CHARS_PER_TOKEN, LEAST_TOKENS, MOST_TOKENS, TOKENS = 4, 100, 8_000, 2_000
#: Turns that a compression is about; characters of a message that are stored.
MOST_NOTED, SYNCED_CHARS = 50, 500


def within_budget(rows: DataFrame, by: list[str], order: list[Column], line: Column, chars: int, extra: int = 0) -> DataFrame:
    """The rows of each group while their lines, ``extra`` characters added to each, fit ``chars``.

    Lengths are positive, so a running sum below the budget is the same as stopping at the
    first overflow, and no more rows than characters can fit: the best of each task are
    taken before any group meets.
    """
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= chars // (1 + extra)).drop("_n")
    used = F.sum(F.length(line) + extra).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= chars)


def release(rows: DataFrame, as_of: Column, tokens: int = TOKENS) -> DataFrame:
    """(session_id, id, line, used): each session's active memories by decayed score, the best of an
    entity and attribute only, while they fit the budget."""
    tokens = min(max(tokens, LEAST_TOKENS), MOST_TOKENS)
    scored = decay(rows.where("status = 'active'"), as_of)
    keyed = (F.col("entity") != "") & (F.col("attribute") != "")
    key = F.when(keyed, F.concat_ws("::", "entity", "attribute")).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    best = Window.partitionBy("session_id", "key").orderBy(F.col("decayed").desc(), F.col("id"))
    first = scored.withColumn("key", key).withColumn("n", F.row_number().over(best)).where("n = 1")
    prefix = F.when(F.col("context_prefix") != "", F.concat(F.lit("["), "context_prefix", F.lit("] "))).otherwise("")
    first = first.withColumn("line", F.concat(F.lit("- ("), "type", F.lit(") "), prefix, "text"))
    order = [F.col("decayed").desc(), F.col("id")]
    return within_budget(first, ["session_id"], order, F.col("line"), tokens * CHARS_PER_TOKEN).select("session_id", "id", "line", "used")


def synced(turns: DataFrame, user_chars: int = 500, assistant_chars: int = 500) -> DataFrame:
    """(session_id, turn, role, type, text): what of the turns is stored.

    A trivial user message drops the turn. The type comes from the whole user message;
    assistant rows are facts and only there if they say something.
    """
    kept = turns.where(~X.is_skipped(F.col("user_message")))
    user = kept.select("session_id", "turn", F.lit("user").alias("role"), X.categorize(F.col("user_message")).alias("type"), F.substring("user_message", 1, user_chars).alias("text"))
    reply = kept.where(F.trim("assistant_response") != "").select(
        "session_id", "turn", F.lit("assistant").alias("role"), F.lit("fact").alias("type"), F.substring("assistant_response", 1, assistant_chars).alias("text")
    )
    return user.unionByName(reply)


def stored_turns(turns: DataFrame, chars: int = SYNCED_CHARS) -> DataFrame:
    """Memories (session_id, turn, role, type, text, importance, entity, attribute, context_prefix, metadata) that turns leave behind.

    Either message of a turn is stored unless it is trivial itself. The type of a user's comes from all it says,
    the rest from what is kept of it; what the assistant says is a fact.
    """
    said = lambda column, role, kind: turns.where(~X.is_skipped(F.col(column))).select(
        "session_id", "turn", F.lit(role).alias("role"), kind.alias("type"), F.substring(F.trim(column), 1, chars).alias("text")
    )
    both = said("user_message", "user", X.categorize(F.col("user_message"))).unionByName(said("assistant_response", "assistant", F.lit("fact")))
    origin = F.to_json(F.struct(F.col("role").alias("source"), F.lit("sync").alias("extraction_method"), F.col("session_id").alias("origin_session_id")))
    return enrich(both, keep_type=True).withColumn("metadata", origin)


def last_turns(turns: DataFrame, most: int) -> DataFrame:
    """The latest ``most`` turns of each session."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("turn").desc()))
    return turns.withColumn("n", n).where(F.col("n") <= most).drop("n")


def session_notes(turns: DataFrame, most: int = MOST_NOTED, products: tuple[str, ...] = ()) -> DataFrame:
    """(session_id, notes): platform, projects and technologies, ``products`` among them, that a session's last ``most`` turns name."""
    said = last_turns(turns, most).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "user_message"))), lambda x: x["user_message"]), " ").alias("said"))
    low = F.lower("said")
    project = F.regexp_extract_all(low, F.lit(P.NOTED_PROJECT), F.lit(0))
    lines = F.concat(
        F.array_compact(
            F.array(
                *(F.when(low.rlike(pattern), note) for pattern, note in P.NOTED_PLATFORMS),
            )
        ),
        F.transform(project, lambda p: F.concat(F.lit("- Project: "), p)),
        F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), f"- Uses: {t}") for t in (*P.TECHNOLOGIES, *products)))),
    )
    return said.select("session_id", F.array_join(lines, "\n").alias("notes"))


def compression_answer(turns: DataFrame, most: int = MOST_NOTED, products: tuple[str, ...] = ()) -> DataFrame:
    """(session_id, answer): the notes of each session in the frame that a compression is answered with."""
    notes = F.col("notes")
    framed = F.concat(F.lit(P.NOTES_FRAME[0]), notes, F.lit(P.NOTES_FRAME[1]), notes, F.lit(P.NOTES_FRAME[2]))
    return session_notes(turns, most, products).select("session_id", F.when(notes == "", P.NO_NOTES).otherwise(framed).alias("answer"))


def recall_lines(sources: list[tuple[str, DataFrame]], chars: int) -> DataFrame:
    """(session_id, source, id, line) of several sources in their order, each id once, within a budget."""
    union = None
    for n, (name, df) in enumerate(sources):
        part = df.select("session_id", F.lit(n).alias("place"), F.lit(name).alias("source"), "rank", "id", "line")
        union = part if union is None else union.unionByName(part)
    first = Window.partitionBy("session_id", "id").orderBy("place", "rank")
    once = union.withColumn("n", F.row_number().over(first)).where("n = 1")
    order = [F.col("place"), F.col("rank"), F.col("id")]
    return within_budget(once, ["session_id"], order, F.col("line"), chars, 1).select("session_id", "source", "id", "line")


def merged_search(abstracts: DataFrame, answers: DataFrame, links: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, title, url, rank): abstract, answer, then links that are no advertisements, ``most`` per query."""
    union = None
    for n, df in enumerate((abstracts, answers, links)):
        part = df.select("query_id", "title", X.redirect_target(F.col("url")).alias("url"), F.lit(n).alias("place"), "position")
        union = part if union is None else union.unionByName(part)
    union = union.where(~F.contains("url", F.lit("duckduckgo.com/y.js")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "position"))
    return union.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "title", "url", "rank")


def core_lines(blocks: DataFrame, chars: int) -> DataFrame:
    """(rank, line) of the core blocks (key, value), by key, as many as fit ``chars``; a line takes its length and one.

    The first chars / 2 blocks are enough, so no window sees more.
    """
    line = F.concat(F.lit("[core:"), "key", F.lit("] "), "value")
    first = blocks.orderBy("key").limit(chars // 2).select("key", line.alias("line"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key"))
    used = F.sum(F.length("line") + 1).over(Window.partitionBy(F.lit(0)).orderBy("key"))
    return first.withColumn("rank", rank).withColumn("used", used).where(F.col("used") <= chars).select("rank", "line")


def recalled_for(queries: DataFrame, hits: DataFrame, rows: DataFrame, edges: DataFrame, blocks: DataFrame, chars: int, entities: int = 3, related: int = 3) -> DataFrame:
    """(query_id, source, rank, line) for each query (query_id): core blocks, search hits (query_id, id, rank), entity rows, graph neighbours.

    Entity rows are the newest ``entities`` of type entity, where a hit has an entity. Graph rows are
    where the ``related`` strongest edges (from_id, to_id, relation, strength) of the best hit lead.
    What an earlier source has isn't there again, and lines stop where the budget ends.
    """
    core = core_lines(blocks, chars)  # no longer than the budget, so each query may have a copy
    memory = rows.select("id", "type", "text", "entity", "created_at", "status")
    found = hits.select("query_id", "id", "rank").join(memory, "id")
    search = found.select("query_id", F.lit(1).alias("place"), F.lit("search").alias("source"), "rank", "id", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), "type", F.lit(") "), "text").alias("line"))
    newest = memory.where("status = 'active' AND type = 'entity'").orderBy(F.col("created_at").desc(), "id").limit(entities)
    newest = newest.select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("created_at").desc(), "id")).alias("rank"), F.concat(F.lit("("), "type", F.lit(") "), "text").alias("line"))
    named = found.where("entity <> ''").select("query_id").distinct()
    entity = named.join(F.broadcast(newest)).select("query_id", F.lit(2).alias("place"), F.lit("entity").alias("source"), "rank", "id", "line")
    best = found.where("rank = 1").select("query_id", F.col("id").alias("from_id"))
    strong = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("strength").desc(), "to_id", "relation"))
    led = best.join(edges.select("from_id", "to_id", "relation", "strength"), "from_id").withColumn("rank", strong).where(F.col("rank") <= related)
    graph = led.join(memory.withColumnRenamed("id", "to_id"), "to_id").select(
        "query_id", F.lit(3).alias("place"), F.lit("graph").alias("source"), "rank", F.col("to_id").alias("id"), F.concat(F.lit("("), "relation", F.lit("→"), "type", F.lit(") "), "text").alias("line")
    )
    own = queries.select("query_id").join(F.broadcast(core)).select("query_id", F.lit(0).alias("place"), F.lit("core").alias("source"), "rank", (-F.col("rank")).cast("long").alias("id"), "line")
    union = own.unionByName(search).unionByName(entity).unionByName(graph)
    first = Window.partitionBy("query_id", "id").orderBy("place", "rank")
    once = union.withColumn("n", F.row_number().over(first)).where("n = 1")
    return within_budget(once, ["query_id"], [F.col("place"), F.col("rank")], F.col("line"), chars, 1).select("query_id", "source", "rank", "line")


def recent_topics(topics: DataFrame, as_of: Column, most: int = 10, seconds: int = 300) -> DataFrame:
    """(session_id, topic, at): the last ``most`` topics (session_id, topic, at) of each session that are younger than ``seconds``."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("at").desc(), F.col("topic")))
    kept = topics.withColumn("n", rank).where(F.col("n") <= most)
    return kept.where(F.col("at") > as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))).select("session_id", "topic", "at")


def formatted_results(results: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, text) of ranked results (query_id, kind, title, url, snippet, rank), ``most`` of each query."""
    one = (
        F.when(F.col("kind") == "abstract", F.concat(F.lit("[Abstract from "), "title", F.lit("]: "), "snippet"))
        .when(F.col("kind") == "answer", F.concat(F.lit("[Answer]: "), "snippet"))
        .otherwise(F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit("\n URL: "), "url", F.lit("\n "), "snippet"))
    )
    rows = results.where(F.col("rank") <= most).select("query_id", F.struct("rank", one.alias("one")).alias("r"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["one"]), "\n\n").alias("text"))


def result_links(html: Column) -> Column:
    """array<struct<title, url, snippet>> of a result page: links of class result-link, each with the snippet cell after it; no advertisements."""
    parts = F.regexp_extract_all(html, F.lit(r"(?is)<a[^>]*class=['\"]result-link['\"][^>]*>.*?(?=<a[^>]*class=['\"]result-link['\"]|\z)"), F.lit(0))
    bare = lambda x: X.decoded_entities(F.trim(F.regexp_replace(x, r"<[^>]+>", "")))
    item = lambda x: F.struct(
        bare(F.regexp_extract(x, r"(?is)^<a[^>]*>(.*?)</a>", 1)).alias("title"),
        X.redirect_target(F.regexp_extract(x, r"(?is)^<a[^>]*href=['\"]([^'\"]+)['\"]", 1)).alias("url"),
        F.substring(bare(F.regexp_extract(x, r"(?is)<td[^>]*class=['\"]result-snippet['\"][^>]*>(.*?)</td>", 1)), 1, 300).alias("snippet"),
    )
    return F.filter(F.transform(parts, item), lambda r: ~F.contains(r["url"], F.lit("duckduckgo.com/y.js")))
