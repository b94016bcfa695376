"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.session import written

#: Parts that the rows of a group or of equal fingerprints are dealt to.
SALTS = 16


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's larger (or, small star, its smaller) neighbours to its least neighbour."""
    both = edges.union(edges.select("v", "u"))
    if not large:
        both = both.where("u > v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns u, v): the least node reachable.

    Self-loops and repeated edges are allowed, null ends are not. Rounds grow with the
    logarithm of the component size; each is written to the shared folder. The least
    neighbour is found by an aggregate with map-side combining, and the join that spreads
    it may be split at run time, so a node of very many links needs no task of its own.
    """
    edges = written(edges.select("u", "v").where("u <> v").distinct(), "components")
    mark = None
    while True:
        edges = written(_star(_star(edges, large=True), large=False), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _salted(large: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """A join on ``key``, of which ``large`` may have one value in very many rows: they are dealt out by ``by``."""
    large = large.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return large.join(small, [key, "_salt"], how).drop("_salt")


def named_groups(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (doc_id, fp) with component_id, the least doc_id of those that have the same fp or one that ``edges`` (u, v) connect with it.

    Null doc_ids name a group only if it has nothing else. Of the distinct fingerprints only
    those of several rows or with edges are joined, each side of a hot key dealt to SALTS parts.
    """
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    found = components(edges).select(F.col("node").alias("fp"), "component")
    fps = written(fps.join(found, "fp", "left").where("n > 1 OR component IS NOT NULL").select("fp", "first", "component"), "groups")
    least = fps.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("component_id"))
    tied = _salted(fps.where("component IS NOT NULL"), least, "component", "fp").select("fp", "component_id")
    named = tied.unionByName(fps.where("component IS NULL").select("fp", F.col("first").alias("component_id"))).withColumn("_named", F.lit(True))
    joined = _salted(rows, named, "fp", "doc_id", "left")
    return joined.select("doc_id", "fp", F.when(F.col("_named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def merged_groups(*found: DataFrame) -> DataFrame:
    """(doc_id, component_id), each doc_id once: the groups of several results (doc_id, component_id) over the same documents, joined where they meet.

    component_id is the least doc_id of a joined group. A null doc_id stays alone only if each
    result leaves one that names its group, and so does a doc_id of several rows.
    """
    rows = reduce(DataFrame.unionByName, (f.select("doc_id", "component_id", F.lit(n).alias("nth")) for n, f in enumerate(found)))
    rows = written(rows.distinct(), "merged-groups")
    first = rows.where("doc_id = component_id").select("doc_id", "nth")
    edges = rows.where("doc_id <> component_id").join(first, ["doc_id", "nth"], "left_anti").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    ties = components(edges).select(F.col("node").alias("doc_id"), "component")
    ids = rows.where("doc_id IS NOT NULL").select("doc_id").distinct()
    named = ids.join(ties, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
    of_null = rows.where("doc_id IS NULL").groupBy("nth").agg(F.max(F.col("component_id").isNull()).alias("alone"), F.min("component_id").alias("c"))
    of_null = of_null.agg(F.min("alone").alias("alone"), F.min("c").alias("c"), F.count("*").alias("n")).where("n > 0")
    return named.unionByName(of_null.select(F.lit(None).cast("long").alias("doc_id"), F.when(~F.col("alone"), F.col("c")).alias("component_id")))
