"""Maintenance by increments equals the full run; one run at a time."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from recollect.operators import incremental, maintenance
from recollect.session import written
from recollect.streaming import ingest

SAID = ["I prefer vim for work", "I prefer emacs for work", "I don't like vim for work", "My name is Ann", "My name is Bob", "I used to love vim for work"]


def test_three_increments_equal_the_full_run(spark):
    rng, draw = np.random.default_rng(2), random.Random(2)
    centres = rng.normal(size=(12, 8))
    v = centres[rng.integers(0, 12, 120)] + rng.normal(scale=0.1, size=(120, 8))
    order = draw.sample(range(120), 120)
    rows = [(i, v[i].tolist(), draw.choice(SAID), "user" if i % 7 else "", draw.choice("abcd"), "active" if i % 11 else "archived") for i in order]
    df = written(spark.createDataFrame(rows, "id long, v array<double>, text string, entity string, attribute string, status string").withColumn("n", F.xxhash64("id") % 3), "rows")
    keyed = lambda found, of: found.join(of.select("id", "entity", "attribute"), "id")
    seen = df.where("n = 99")
    copies, clashes = maintenance.duplicates(seen.select("id", "v"), 0.9), keyed(maintenance.contradictions(seen), seen)
    for part in ("n < 0", "n = 0", "n > 0"):
        new = df.where(part)
        now = seen.unionByName(new)
        copies = written(incremental.duplicates_after(copies, seen.select("id", "v"), new.select("id", "v"), 0.9), "copies")
        clashes = written(incremental.contradictions_after(clashes, now, new), "clashes")
        assert sorted(map(tuple, copies.collect())) == sorted(map(tuple, maintenance.duplicates(now.select("id", "v"), 0.9).collect()))
        full = keyed(maintenance.contradictions(now), now).select("id", "superseded_by", "reason", "entity", "attribute")
        assert sorted(map(tuple, clashes.collect())) == sorted(map(tuple, full.collect()))
        seen = now
    assert copies.count() and clashes.count()


def test_a_lease_is_for_one(spark, tmp_path):
    a, b = (incremental.Lease(spark, f"file://{tmp_path}/lease", 60) for _ in range(2))
    assert a.take() and not b.take()
    a.give()
    assert b.take() and not a.take()
    os.utime(tmp_path / "lease", (0, 0))  # its owner died long ago
    assert a.take()


def test_maintenance_loop_runs_alone(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/in")
    lease, runs = incremental.Lease(spark, f"file://{tmp_path}/lease", 3600), []
    loop = lambda name: ingest.maintenance_loop(spark.readStream.schema("id long").parquet(f"file://{tmp_path}/in"), lambda: runs.append(lease.take()), f"file://{tmp_path}/{name}", "1 second", lease)
    assert lease.take()
    q = loop("busy")
    q.processAllAvailable()
    q.stop()
    assert runs == []
    lease.give()
    q = loop("free")
    q.processAllAvailable()
    q.stop()
    assert runs == [False]  # while it ran, nobody else could
    assert lease.take()


def test_next_event_in_one_long_range(spark):
    """60,000 requests in one range take seconds: a frame that shrinks was gone through anew for each of them."""
    import time

    from pyspark.sql import functions as F

    from recollect.operators.adjacent import next_at

    rows = spark.range(60_000).select(F.lit("k").alias("key"), (F.col("id") * 2).alias("at"))
    began = time.perf_counter()
    found = next_at(rows, rows.select("key", (F.col("at") + 1).alias("at")), "key", "at", "into")
    assert found.where("into IS NULL OR into <> at + 1").count() == 1
    assert time.perf_counter() - began < 60
