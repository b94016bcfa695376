"""Operators against plain Python and DuckDB, streams, and the driver contract."""

import datetime as dt
import os
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from recollect import session
from recollect.operators import context, graph, maintenance, mutations, retrieval
from recollect.plans import registry
from recollect.sources import memories as M
from recollect.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, float, np.number)):
        return round(float(value), 6)
    return str(value)


def table(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    assert table(registry.QUERIES[name](spark, SF).toPandas()) == table(duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert registry.QUERIES["mmr_rerank"](spark, SF).count() == 5 * 25
    assert registry.QUERIES["edges_by_text"](spark, SF).count() >= 0


def vectors(spark, n=60, seed=1):
    v = np.random.default_rng(seed).normal(size=(n, 8))
    v[n // 2 :] = v[: n - n // 2] + np.random.default_rng(2).normal(size=(n - n // 2, 8)) * 0.01
    v[0] = 0
    return v, spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")


def cosines(v):
    size = np.linalg.norm(v, axis=1)
    return np.divide(v @ v.T, np.outer(size, size), out=np.zeros((len(v), len(v))), where=np.outer(size, size) > 1e-10)


def test_duplicates_are_the_greedy_pass(spark):
    v, df = vectors(spark)
    c, gone, want = cosines(v), set(), {}
    for i in range(len(v)):
        for j in range(i + 1, len(v)):
            if c[i, j] > 0.92 and i not in gone and j not in gone:
                want[i] = j
                gone.add(i)
    assert {r.id: r.superseded_by for r in maintenance.duplicates(df).collect()} == want
    assert {r.id for r in maintenance.marked_invalid(df).collect()} == {i for i in range(60) for j in range(i + 1, 60) if c[i, j] > 0.92}
    small = {(r.i, r.j) for r in retrieval.similarities(df, df, 0.5, block=7).collect()}
    assert small == {(i, j) for i in range(60) for j in range(60) if i != j and c[i, j] > 0.5}


def test_summaries_come_in_parts(spark):
    kinds = ["event", "project", "odd", "fact"]
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=-i)
    rows = [(i, day(i // 3), None if i == 5 else "x" * (i % 7) + str(i), kinds[i % 4], i / 100, f"e{i % 2}") for i in range(40)]
    members = [(i % 2, i) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp, text string, type string, importance double, entity string")
    pairs = spark.createDataFrame(members, "cluster long, id long")
    for chars in (1, 20, 10_000):
        want = {}
        for c in (0, 1):
            at = 0
            for r in sorted((r for r in rows if r[0] % 2 == c), key=lambda r: (r[1], r[0])):
                want.setdefault((c, at // chars), []).append(r)
                at += len(r[2] or "") + 3
        got = {(r.cluster, r.part): r for r in maintenance.summaries(df, pairs, chars).collect()}
        assert {k: (r.text, r.source_memory_ids) for k, r in got.items()} == {k: (" | ".join(r[2] for r in v if r[2] is not None), sorted(r[0] for r in v)) for k, v in want.items()}
        assert {(r.cluster, r.type, round(r.importance, 6), r.context_prefix) for r in got.values()} == {
            (0, "odd", 0.58, "Consolidated 20 memories about e0:"),
            (1, "project", 0.59, "Consolidated 20 memories about e1:"),
        }
    assert maintenance.summaries(df, pairs.limit(0)).count() == 0


def test_words_as_patterns_say(spark):
    from recollect.functions import patterns as P
    from recollect.functions import text as X

    lists = [p for _, p in P.CATEGORY_PATTERNS] + [P.CRITICAL, P.IDENTITY_HINT, P.UNCERTAIN]
    texts = [(t,) for p in lists for w in p.split("|") for t in (w, f"a{w}b", w[1:], f"\n{w}\n{w}")] + [("",), (None,)]
    df = spark.createDataFrame(texts, "t string")
    for p in lists:
        assert df.where(~X.says(F.col("t"), p).eqNullSafe(F.col("t").rlike(p))).isEmpty(), p


def test_mmr_is_greedy(spark):
    v, df = vectors(spark)
    c = cosines(v)
    hits = [(q, int(i), float(s)) for q in (1, 2) for i, s in enumerate(np.round(np.random.default_rng(q).random(60), 3))]
    got = {}
    for r in retrieval.mmr(spark.createDataFrame(hits, "query_id long, id long, score double"), df, 5, 0.6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q in (1, 2):
        score = {i: s for a, i, s in hits if a == q}
        chosen = [min(score, key=lambda i: (-score[i], i))]
        while len(chosen) < 5:
            left = [i for i in score if i not in chosen]
            chosen.append(max(left, key=lambda i: (0.6 * score[i] - 0.4 * max(0.0, *(c[i, k] for k in chosen)), score[i], -i)))
        assert [i for _, i in sorted(got[q])] == chosen


def test_lineage_stops(spark):
    chain = [(i, i + 1 if i < 70 else None) for i in range(71)] + [(100, 999), (101, 100)]
    got = {r.id: r for r in graph.lineage(spark.createDataFrame(chain, "id long, superseded_by long")).collect()}
    assert (got[0].last, got[0].steps, got[0].truncated) == (50, 50, True)
    assert (got[30].last, got[30].steps, got[30].truncated) == (70, 40, False)
    assert (got[20].last, got[20].truncated) == (70, False) and got[101].last == 100 and 100 not in got


def test_walks_and_cycles(spark):
    rows = [(1, 1, 2, "a", 0.5, None), (2, 2, 1, "b", 0.9, None), (3, 2, 3, "c", 0.1, dt.datetime(2020, 1, 1))]
    edges = spark.createDataFrame(rows, M.EDGE_SCHEMA)
    starts = spark.createDataFrame([(1,)], "start long")
    walks = graph.traverse(edges, starts, M.as_of()).collect()
    assert [r.depth for r in sorted(walks, key=lambda r: r.depth)] == [1, 2, 3, 4, 5] and walks[0].path == "1-a->2"
    assert [r.to_id for r in graph.traverse(edges, starts, M.as_of(), acyclic=True).collect()] == [2]
    nodes = spark.createDataFrame([(2,)], "node long")
    assert {(r.other, r.direction) for r in graph.neighbours(edges, nodes, M.as_of()).collect()} == {(1, "in"), (1, "out")}
    groups = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (9, 9)], "u long, v long")
    assert {(r.node, r.component) for r in graph.components(groups).collect()} == {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)}


def test_mutations(spark):
    blocks = spark.createDataFrame([("a", "old", 1), ("b", "x", 1)], "key string, value string, at long")
    writes = spark.createDataFrame([("a", "n" * 600, 2), ("c", "y", 2)], "key string, value string, at long")
    got = {r.key: r.value for r in mutations.upserted_blocks(blocks, writes).collect()}
    assert got == {"a": "n" * 500, "b": "x", "c": "y"}
    rows = spark.createDataFrame([(1, 2, "invalid"), (2, None, "invalid"), (3, None, "active")], "id long, superseded_by long, status string")
    assert {r.id for r in mutations.without(rows, rows.where("status = 'invalid'").select("id")).collect()} == {2, 3}


def test_export_and_import(spark, tmp_path):
    rows = spark.createDataFrame([(1, "active", "fact", "a"), (2, "archived", "fact", "b"), (3, "active", "odd", "c")], "id long, status string, type string, text string")
    M.write_export(rows, f"file://{tmp_path}/x")
    back = M.read_export(spark, f"file://{tmp_path}/x")
    assert {(r.id, r.type) for r in back.collect()} == {(1, "fact"), (3, "fact")} and back.columns[:3] == ["id", "session_id", "type"]
    M.append(rows, f"file://{tmp_path}/t")
    M.append(rows, f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 6


def streamed(spark, tmp_path, rows, schema, plan, expected):
    """Run until ``expected`` rows are out: queries with timeouts always have another batch to run."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = plan(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
    name = "out_" + tmp_path.name.replace("-", "_")
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        for _ in range(120):
            if spark.table(name).count() >= expected or not q.isActive:
                break
            time.sleep(0.5)
        return spark.table(name).collect()
    finally:
        q.stop()


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_rate_limit(spark, tmp_path):
    rows = [("a", at(s)) for s in (0, 1, 2, 59, 61, 62)] + [("b", at(5))]
    got = streamed(spark, tmp_path, rows, "key string, ts timestamp", lambda s: ingest.rate_limited(s, 60, 2), 7)
    allowed = {(r.key, (r.ts - at(0)).seconds) for r in got if r.allowed}
    assert allowed == {("a", 0), ("a", 1), ("a", 61), ("a", 62), ("b", 5)} and len(got) == 7


def test_research_throttle(spark, tmp_path):
    rows = [("s", at(s), f"t{s}") for s in (0, 10, 31, 60, 62, 93, 5000)]
    plan = lambda s: ingest.research_throttled(s.withWatermark("ts", "1 hour"), 30, 3)
    got = streamed(spark, tmp_path, rows, "session_id string, ts timestamp, topic string", plan, 4)
    assert {r.topic for r in got} == {"t0", "t31", "t62", "t5000"}


def test_embedding_sink_retries(spark, tmp_path):
    spark.range(5).write.parquet(f"file://{tmp_path}/in")
    tries = []

    def embed(batch):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("not ready")
        return batch.withColumn("v", F.array(F.lit(0.5)))

    q = ingest.embedding_sink(spark.readStream.schema("id long").parquet(f"file://{tmp_path}/in"), embed, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 5 and len(tries) == 3


def test_fetches_that_were_refused_dont_count(spark):
    rows = [("a", at(s), i) for i, s in enumerate((0, 10, 20, 30, 61, 62, 71))] + [("b", at(0), 20), ("b", at(0), 21), ("b", at(0), 22)]
    got = ingest.fetch_limited(spark.createDataFrame(rows, "key string, ts timestamp, id long"), 60, 2).collect()
    assert {r.id for r in got if r.allowed} == {0, 1, 4, 6, 20, 21}
    assert {r.id: r.recent for r in got}[3] == 2


def test_maintenance_steps_in_their_order(spark):
    """A contradiction replaces what a duplicate set; a summary replaces both; its members have one."""
    v = [[1.0, 0.0], [1.0, 0.001], [0.0, 1.0], [0.01, 1.0], [0.02, 1.0], [0.5, 0.5]]
    said = ["I prefer vim for work", "I prefer emacs for work", *["I use a tool for work"] * 3, "plain"]
    rows = [(i, "s", "fact", said[i], "active", None, '{"use_count":0}', at(i), 1, 0.9 if i < 2 else 0.2, "user" if i < 5 else "", "p" if i < 2 else "" if i == 5 else f"q{i}") for i in range(6)]
    schema = "id long, session_id string, type string, text string, status string, superseded_by long, metadata string, created_at timestamp, recall_count long, importance double, entity string, attribute string"
    df = spark.createDataFrame(rows, schema).withColumn("context_prefix", F.lit(""))
    got = {r.id: (r.status, r.superseded_by) for r in maintenance.next_state(df, spark.createDataFrame(list(enumerate(v)), "id long, v array<double>"), M.as_of()).collect()}
    assert got[0] == ("superseded", 1) and got[1] == ("active", None) and got[5] == ("active", None)
    assert {got[i] for i in (2, 3, 4)} == {("superseded", 8)} and got[8] == ("active", None) and len(got) == 7


def test_pairs_that_state_uses(spark):
    rows = spark.createDataFrame([(0, "fact", "I use X"), (1, "fact", "so be it"), (2, "fact", "never again"), (3, "general", "I like X")], "id long, type string, text string")
    v = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(4)], "id long, v array<double>")
    assert {(r.i, r.j) for r in maintenance.contradicting_pairs(rows, v).collect()} == {(0, 1), (0, 2)}


def test_pairs_by_key_and_best_in_block(spark):
    v, df = vectors(spark)
    c = cosines(v)
    keyed = df.withColumn("e", F.col("id") % 3)
    got = [(r.i, r.j) for r in retrieval.similar_pairs(keyed, 0.1, ("e",), block=4).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 3 == j % 3 and c[i, j] > 0.1}
    near = retrieval.knn(df, df, 3).collect()
    want = {(i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i), key=lambda j: (-c[i, j], j))[:3]}
    assert {(r.query_id, r.id) for r in near} == want


def test_result_page_and_notes(spark):
    page = (
        "<a rel=\"nofollow\" href='//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.org%2Fa&rut=1' class='result-link'>A &amp; <b>B</b></a>\n<td class='result-snippet'>says <b>it</b></td>"
        "<a class=\"result-link\" href=\"https://duckduckgo.com/y.js?ad=1\">Ad</a><td class='result-snippet'>buy</td><a class='result-link' href='https://y.org/'>Y</a>"
    )
    got = spark.createDataFrame([(page,)], "html string").select(context.result_links(F.col("html")).alias("r")).first().r
    assert [tuple(r) for r in got] == [("A & B", "https://x.org/a", "says it"), ("Y", "https://y.org/", "")]
    turns = [("s", 1, "I am building a small parser."), ("s", 2, "on Ubuntu with Docker"), ("t", 1, "hello")]
    notes = {r.session_id: r.notes for r in context.session_notes(spark.createDataFrame(turns, "session_id string, turn long, user_message string")).collect()}
    assert "- Uses: docker" in notes["s"] and "- Working in WSL/Linux environment confirmed" in notes["s"] and "- Project: building a small parser" in notes["s"] and notes["t"] == ""


def test_scratch_folder_has_to_be_named_on_a_cluster():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert session.scratch_root(Session()) == "hdfs://x/y"


def test_many_equal_vectors_give_no_more_than_the_best(spark):
    """Of vectors that are all alike a query keeps its k least ids, and each id its next: once all of them left the task."""
    df = spark.range(1200).select("id", F.array(*(F.lit(x) for x in (0.1, 0.7, -0.3))).alias("v"))
    a, b = retrieval._met(df, df, (), 100)
    assert retrieval._multiplied(a, b, (), 0.0, 3).groupBy("i", F.pmod(F.xxhash64("j"), F.lit(12))).count().agg(F.max("count")).first()[0] <= 3
    near = {}
    for r in retrieval.knn(df, df, 3).collect():
        near.setdefault(r.query_id, []).append((r["rank"], r.id))
    assert all([x for _, x in sorted(near[i])] == [j for j in range(4) if j != i][:3] for i in range(1200))
    found = retrieval.similar_pairs(df, 0.9, block=100, least=True).collect()
    assert len(found) < 1200 * 20 and {r.i for r in found} == set(range(1199)) and all(r.i < r.j for r in found)
