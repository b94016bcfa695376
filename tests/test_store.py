"""The stored table, the limits of requests over stored events, and the queue of rows to embed."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from recollect.operators import limits, mutations
from recollect.sources.store import Store
from recollect.streaming import ingest


def table(spark, n):
    rows = [(i, "active" if i % 5 else "archived", f"t{i}", 0, 0.5) for i in range(n)]
    return spark.createDataFrame(rows, "id long, status string, text string, recall_count long, importance double").repartition(4)


def content(store, *status):
    return {r.id: (r.status, r.text, r.recall_count) for r in store.read(*status).collect()}


def test_changes_write_the_parts_they_touch(spark, tmp_path):
    store = Store.create(table(spark, 1000), str(tmp_path / "store"), 50)
    want = {i: ("active" if i % 5 else "archived", f"t{i}", 0) for i in range(1000)}
    assert content(store) == want
    assert content(store, "archived") == {i: w for i, w in want.items() if w[0] == "archived"}
    # one percent of the rows, the newest: one part of twenty is written
    hits = spark.createDataFrame([(i,) for i in range(990, 1000)] + [(995,)], "id long")
    assert store.change(hits, mutations.recalled) == {19: 50}
    for i in range(990, 1000):
        want[i] = (*want[i][:2], 2 if i == 995 else 1)
    assert content(store) == want
    assert store.append(table(spark, 1003).where("id >= 1000")) == {20: 3}
    want |= {i: ("active" if i % 5 else "archived", f"t{i}", 0) for i in range(1000, 1003)}
    gone = spark.createDataFrame([(i,) for i in range(100, 150)], "id long")
    assert store.change(gone, lambda rows, ids: rows.join(ids, "id", "left_anti")) == {2: 0}
    want = {i: w for i, w in want.items() if not 100 <= i < 150}
    assert content(store) == want
    assert {r.id for r in store.lookup(spark.createDataFrame([(3,), (120,), (1001,), (None,), (3,)], "id long")).collect()} == {3, 1001}
    assert store.change(gone.limit(0), mutations.recalled) == {}


def test_a_killed_change_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = Store.create(table(spark, 200), str(tmp_path / "store"), 50)
    before = content(store)
    hits = spark.createDataFrame([(7,), (60,)], "id long")

    def dies(self):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(type(spark.range(0)), "coalesce", lambda self, n: dies(self))  # after the data, before the commit
        with pytest.raises(KeyboardInterrupt):
            store.change(hits, mutations.recalled)
    assert content(store) == before
    # what is left of the dead attempt isn't taken for the next one's
    store.change(hits.where("id = 7"), mutations.recalled)
    after = content(store)
    assert after[7][2] == 1 and after[60][2] == 0 and len(after) == 200


def test_files_do_not_grow_with_parts(spark, tmp_path):
    """Many small parts are written to a few files, and a change of all of them too."""
    files = lambda: len(list(tmp_path.glob("store/data/**/*.parquet")))
    store = Store.create(table(spark, 1000), str(tmp_path / "store"), 5)
    made = files()
    assert made <= 24
    want = content(store)
    hits = spark.range(0, 1000, 10)
    assert store.change(hits, mutations.recalled) == {p: 5 for p in range(0, 200, 2)}
    assert files() <= 2 * made
    want |= {i: (*want[i][:2], 1) for i in range(0, 1000, 10)}
    assert content(store) == want
    assert {r.id: r.recall_count for r in store.lookup(spark.createDataFrame([(0,), (5,), (10,)], "id long")).collect()} == {0: 1, 5: 0, 10: 1}


def test_plans_open_what_they_need(spark, tmp_path):
    store = Store.create(table(spark, 1000), str(tmp_path / "store"), 50)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scan = plan(store.read("archived"))
    assert "PartitionFilters: [isnotnull(_status" in scan and "Exchange" not in scan
    few = plan(store.lookup(spark.createDataFrame([(5,), (77,)], "id long")))
    assert "BroadcastHashJoin" in few and "SortMergeJoin" not in few


def by_hand(requests, seconds, most):
    out, state = {}, {}
    for key, us, i in sorted(requests, key=lambda r: (r[0], r[1], r[2])):
        start, n = state.get(key, (None, 0))
        if start is None or us - start >= seconds * 1_000_000:
            start, n = us, 0
        state[key] = (start, n + 1)
        out[i] = (start, n + 1 <= most)
    return out


def test_windows_from_the_first_request(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 9)}", int(rng.random() * 3_000_000_000), i) for i in range(3000)]
    rows += [("edge", 0, 9000), ("edge", 59_999_999, 9001), ("edge", 60_000_000, 9002), ("edge", 60_000_000, 9003), ("edge", 180_000_000, 9004)]
    df = spark.createDataFrame(rows, "key string, us long, id long").select("key", F.timestamp_micros("us").alias("ts"), "id").repartition(5)
    got = {r.id: (r.us, r.allowed) for r in limits.rate_limited(df, 60, 20).select("id", F.unix_micros("start").alias("us"), "allowed").collect()}
    assert got == by_hand(rows, 60, 20)
    assert limits.rate_limited(df.limit(0)).count() == 0
    none = df.limit(2).withColumn("key", F.lit(None).cast("string"))
    assert limits.rate_limited(none).count() == 0


def embed(texts):
    if any("bad" in t for t in texts):
        raise ValueError("bad text")
    return [[float(len(t))] for t in texts]


def test_embed_queue_is_bounded_and_writes_once(spark, tmp_path):
    folder = lambda x: f"file://{tmp_path}/{x}"
    spark.range(0, 60).select("id", F.when(F.col("id") % 20 == 3, "bad").when(F.col("id") == 5, None).otherwise(F.lit("ab")).alias("text")).coalesce(1).write.parquet(folder("in"))
    source = lambda: spark.readStream.schema("id long, text string").parquet(folder("in"))
    q = ingest.embed_queue(source(), embed, folder("out"), folder("cp"), most=50, size=10, tries=2)
    q.processAllAvailable()
    q.stop()
    vectors = lambda: {r.id: r.v for r in ingest.embedded(spark, folder("out")).collect()}
    bad = {3, 23, 43}
    assert vectors() == {i: [0.0 if i == 5 else 2.0] for i in range(50) if i not in bad}
    dead = spark.read.parquet(folder("out/dead")).collect()
    assert {r.id for r in dead} == bad and all(r.error == "ValueError: bad text" for r in dead)
    assert {r.id for r in spark.read.parquet(folder("out/dropped")).collect()} == set(range(50, 60))
    # a process that died before its batch was noted runs it again
    shutil.rmtree(f"{tmp_path}/cp/commits")
    spark.createDataFrame([(100, "abc")], "id long, text string").write.mode("append").parquet(folder("in"))
    q = ingest.embed_queue(source(), embed, folder("out"), folder("cp"), most=50, size=10, tries=2)
    q.processAllAvailable()
    q.stop()
    assert vectors() == {i: [0.0 if i == 5 else 2.0] for i in range(50) if i not in bad} | {100: [3.0]}
    assert spark.read.parquet(folder("out/vectors")).count() == 48
