"""Vector index, adjacent rows and traversal: equal to the plain way, and no more work than promised."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from recollect.operators import adjacent, graph
from recollect.sources.vector_index import VectorIndex


def nearest(x, ids, queries, k, floor=-1.0):
    out = []
    for q in queries:
        a = x[ids.index(q)]
        scored = []
        for i, b in zip(ids, x, strict=True):
            size = np.linalg.norm(a) * np.linalg.norm(b)
            c = float(a @ b / size) if size >= 1e-10 else 0.0
            if i != q and c > floor:
                scored.append((-round(c, 9), i))
        out += [(q, i, rank) for rank, (_, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def clustered(rng, n, dims, centres):
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + rng.normal(scale=0.05, size=(n, dims))


def test_vector_index_is_exact_and_prunes_clusters(spark, tmp_path):
    rng = np.random.default_rng(3)
    for name, x in (("clusters", clustered(rng, 900, 16, 30)), ("random", rng.normal(size=(500, 16)))):
        x[7], x[8] = 0.0, x[9]  # no direction; two alike
        ids = list(range(len(x)))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>").repartition(3)
        index = VectorIndex.create(df, str(tmp_path / name), block=50)
        queries = df.where("id % 20 = 0 OR id IN (7, 8)")
        asked = [i for i in ids if i % 20 == 0 or i in (7, 8)]
        got = sorted((r.query_id, r.id, r.rank) for r in index.search(queries, 5).collect())
        assert got == nearest(x, ids, asked, 5)
        got = sorted((r.query_id, r.id, r.rank) for r in index.search(queries, 400, 0.3).collect())
        assert got == nearest(x, ids, asked, 400, 0.3)
        share = index.compared(queries, 5) / (len(asked) * len(x))
        assert share < 0.25 if name == "clusters" else share <= 1.0


def test_vector_index_of_few(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, v array<double>")
    index = VectorIndex.create(df, str(tmp_path / "few"))
    assert [(r.query_id, r.id) for r in index.search(df.where("id = 1"), 5).collect()] == [(1, 2)]
    none = VectorIndex.create(df.limit(0), str(tmp_path / "none"))
    assert none.search(df.where("id = 1"), 5).count() == 0


def test_next_rows_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice("abc"), rng.choice(["x", None]), f"t{i}") for i in rng.sample(range(10_000), 2000)]
    df = spark.createDataFrame(rows, "id long, k string, l string, t string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = adjacent.with_next(df, ("k", "l"), "id", "t")
        got = {r.id: (r.next_id, r.next_t) for r in found.collect()}
        spread = found.where("k = 'hot' AND l = 'x'").select("id").withColumn("p", F.spark_partition_id()).select("p").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = defaultdict(list)
    for i, k, l, t in rows:
        by[k, l].append((i, t))
    want = {}
    for group in by.values():
        group.sort()
        want |= {a[0]: b for a, b in zip(group, [*group[1:], (None, None)], strict=True)}
    assert got == want
    assert spread > 1
    assert adjacent.with_next(df.limit(0), ("k",), "id").count() == 0


def test_reach_on_a_hub(spark):
    """Everything leads into a hub and out of it again: walks multiply, what is reached does not."""
    n = 40
    edges = [(i, 1000, "in") for i in range(n)] + [(1000, i, "out") for i in range(n)] + [(0, 1, "next"), (0, 1, "also"), (5, 6, "gone")]
    df = spark.createDataFrame(edges, "from_id long, to_id long, relation string").withColumn(
        "valid_until", F.when(F.col("relation") == "gone", F.lit("2000-01-01").cast("timestamp"))
    )
    starts = spark.createDataFrame([(i,) for i in [*range(n), 77, None, 3]], "start long")
    found = graph.reached(df, starts, F.lit("2024-01-01").cast("timestamp"), 6)
    rows = found.collect()
    assert len(rows) == len({(r.start, r.node) for r in rows}) == n * (n + 1) + 1
    assert {r.depth for r in rows} == {0, 1, 2}
    ways = {(r.start, r.node): (r.depth, r.path) for r in graph.paths(found).collect()}
    assert ways[0, 1] == (1, "0-also->1")
    assert ways[5, 6] == (2, "5-in->1000-out->6")
    assert ways[77, 77] == (0, "77")
    assert len(ways) == len(rows)


def test_small_and_large_graphs_have_the_same_components(spark, monkeypatch):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(5, 5)], "u long, v long")
    small = sorted(map(tuple, graph.components(df).collect()))
    monkeypatch.setattr(graph, "SMALL_GRAPH", 0)
    assert sorted(map(tuple, graph.components(df).collect())) == small
