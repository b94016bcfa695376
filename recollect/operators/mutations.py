"""Mutations as next states: a table and the changes to it give the table after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as X

RECALL_BOOST, FEEDBACK_BOOST = 0.01, 0.03
BLOCK_CHARS, MOST_LEVEL, CITATION_CHARS = 500, 3, 200


def _raised(importance: Column, by: float, times: Column) -> Column:
    """min(1, ...) after each of several raises is min(1, ...) of their sum."""
    return F.least(F.lit(1.0), importance + by * times)


def recalled(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Count recalls: hits (id), one row per recall."""
    n = hits.groupBy("id").agg(F.count("*").alias("n"))
    joined = rows.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    joined = joined.withColumn("importance", F.when(F.col("n") > 0, _raised(F.col("importance"), RECALL_BOOST, F.col("n"))).otherwise(F.col("importance")))
    return joined.withColumn("recall_count", F.col("recall_count") + F.col("n")).select(*rows.columns)


def fed_back(rows: DataFrame, used: DataFrame) -> DataFrame:
    """Raise active rows that were used: used (id), one row per use; counts go to metadata."""
    n = used.groupBy("id").agg(F.count("*").alias("n"))
    joined = rows.join(n, "id", "left").withColumn("n", F.when(F.col("status") == "active", F.coalesce("n", F.lit(0))).otherwise(0))
    uses = F.coalesce(F.get_json_object("metadata", "$.use_count").cast("long"), F.lit(0)) + F.col("n")
    fields = F.map_concat(
        F.map_filter(F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,string>"), lambda k, v: k != "use_count"),
        F.create_map(F.lit("use_count"), uses.cast("string")),
    )
    changed = F.col("n") > 0
    joined = joined.withColumn("metadata", F.when(changed, F.to_json(fields)).otherwise(F.col("metadata")))
    joined = joined.withColumn("importance", F.when(changed, _raised(F.col("importance"), FEEDBACK_BOOST, F.col("n"))).otherwise(F.col("importance")))
    return joined.select(*rows.columns)


def superseded(rows: DataFrame, pairs: DataFrame, as_of: Column) -> DataFrame:
    """Apply pairs (old_id, new_id, reason): old rows end and point to the new, which begins and lists its sources.

    A new row of several pairs lists all of them; of several successors of an old row the last id stays.
    """
    old = pairs.groupBy(F.col("old_id").alias("id")).agg(F.max("new_id").alias("_by"))
    new = pairs.groupBy(F.col("new_id").alias("id")).agg(F.sort_array(F.collect_set("old_id")).alias("_from"), F.max("reason").alias("_reason"))
    joined = rows.join(old, "id", "left").join(new, "id", "left")
    ends, begins = F.col("_by").isNotNull(), F.col("_from").isNotNull()
    sources = F.array_union(F.coalesce("source_memory_ids", F.array().cast("array<bigint>")), "_from")
    why = F.to_json(F.struct(F.element_at("_from", -1).alias("supersedes"), F.col("_reason").alias("reason")))
    return joined.select(
        *(F.col(c) for c in rows.columns if c not in ("status", "superseded_by", "valid_until", "valid_from", "source_memory_ids", "metadata")),
        F.when(ends, "superseded").otherwise(F.col("status")).alias("status"),
        F.when(ends, F.col("_by")).otherwise(F.col("superseded_by")).alias("superseded_by"),
        F.when(ends, as_of).otherwise(F.col("valid_until")).alias("valid_until"),
        F.when(begins, F.coalesce("valid_from", as_of)).otherwise(F.col("valid_from")).alias("valid_from"),
        F.when(begins, sources).otherwise(F.col("source_memory_ids")).alias("source_memory_ids"),
        F.when(begins, why).otherwise(F.col("metadata")).alias("metadata"),
    )


def with_status(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Set status of the ids in changes (id, new_status)."""
    return rows.join(changes, "id", "left").withColumn("status", F.coalesce("new_status", "status")).select(*rows.columns)


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Delete ids (id) that no other row points to; a row that is pointed to stays."""
    kept = rows.where("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("id"))
    return rows.join(ids.join(kept, "id", "left_anti"), "id", "left_anti")


def inserted_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Append edges whose two ends exist in nodes (id)."""
    a, b = (nodes.select(F.col("id").alias(name)).distinct() for name in ("from_id", "to_id"))
    return edges.unionByName(new.join(a, "from_id", "left_semi").join(b, "to_id", "left_semi"), allowMissingColumns=True)


def ended_edges(edges: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """End edges that are still open."""
    marked = edges.join(ids.select("id", F.lit(True).alias("_end")), "id", "left")
    return marked.withColumn("valid_until", F.when(F.col("_end") & F.col("valid_until").isNull(), as_of).otherwise(F.col("valid_until"))).drop("_end")


def upserted_blocks(blocks: DataFrame, writes: DataFrame, most: int = BLOCK_CHARS) -> DataFrame:
    """Keyed blocks (key, value, at) after writes of the same shape; the latest write of a key stays, cut to size."""
    both = blocks.select("key", "value", "at").unionByName(writes.select("key", F.substring("value", 1, most).alias("value"), "at"))
    return both.groupBy("key").agg(F.max(F.struct("at", "value")).alias("b")).select("key", "b.value", "b.at")


def compressed(rows: DataFrame, ids: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """(rows with the ids at ``level``, raw texts (id, text) of those that had none before)."""
    level = min(level, MOST_LEVEL)
    chosen = rows.join(ids.select("id"), "id", "left_semi")
    raw = chosen.where("compression_level = 0").select("id", "text")
    marked = rows.join(ids.select("id", F.lit(True).alias("_now")), "id", "left")
    now = F.coalesce("_now", F.lit(False))
    out = marked.withColumn("text", F.when(now, X.compressed(F.col("text"), level)).otherwise(F.col("text")))
    return out.withColumn("compression_level", F.when(now, level).otherwise(F.col("compression_level"))).select(*rows.columns), raw


def raw_text(rows: DataFrame, raw: DataFrame) -> DataFrame:
    """(id, text): as stored at level 0, else the raw text if it was kept."""
    kept = raw.select("id", F.col("text").alias("raw"))
    text = F.when(F.col("compression_level") == 0, F.col("text")).otherwise(F.coalesce("raw", "text"))
    return rows.join(kept, "id", "left").select("id", text.alias("text"))


def cited(log: DataFrame, new: DataFrame) -> DataFrame:
    """Append citations (memory_id, session, context, cited_at)."""
    return log.unionByName(new.withColumn("context", F.substring("context", 1, CITATION_CHARS)), allowMissingColumns=True)


def removed_blocks(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """Blocks without those of the keys (key)."""
    return blocks.join(keys.select("key").distinct(), "key", "left_anti")


def upserted_vectors(vectors: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """Vectors (id, v) after new ones of the same shape took the place of those of their ids and ``gone`` (id) went."""
    kept = vectors.join(new.select("id"), "id", "left_anti").unionByName(new.select("id", "v"))
    return kept.join(gone.select("id"), "id", "left_anti")


def to_embed(rows: DataFrame, vectors: DataFrame, most: int = 100) -> DataFrame:
    """(id, text): what active rows without a vector are embedded by, prefix first, the least ids."""
    missing = rows.where("status = 'active'").join(vectors.select("id"), "id", "left_anti").orderBy("id").limit(most)
    return missing.select("id", F.concat(F.when(F.col("context_prefix") != "", F.concat("context_prefix", F.lit(" "))).otherwise(""), "text").alias("text"))
