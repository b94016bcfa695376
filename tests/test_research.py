"""The research throttle replayed as a stream, against a plain loop; what is idle is forgotten."""

import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from recollect.streaming import research

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def by_hand(events, gap, most, idle):
    state, out = {}, []
    for session, at, kind, topic in sorted(events, key=lambda e: (e[1], e[2])):
        running, last, done, topics = state.get(session, (False, None, 0, []))
        if last is not None and at - last > idle:
            last, done, topics = None, 0, []
        if kind == "ask":
            decision = "running" if running else "early" if last is not None and at - last < gap else "full" if done >= most else "start"
            if decision == "start":
                running, last = True, at
        else:
            decision, running = kind, False
            if kind == "done":
                done, topics = done + 1, [*topics, topic][-10:]
        state[session] = (running, last, done, topics)
        out.append((session, at, topic, decision, done, tuple(topics)))
    return sorted(out)


def test_replayed_stream(spark, tmp_path):
    rng = random.Random(4)
    events = []
    for session in ("a", "b", "c"):
        at = 0
        for i in range(60):
            at += rng.choice([5, 20, 40, 40, 60, 4000])
            events.append((session, at, rng.choice(["ask", "ask", "done", "failed"]), f"t{i}"))
    events.append(("z", 1_000_000, "ask", "last"))  # moves time on, so that all others are forgotten
    files = sorted(events, key=lambda e: e[1])
    size = -(-len(files) // 4)
    schema = "session_id string, at long, kind string, topic string"
    for n in range(4):
        spark.createDataFrame(files[n * size : (n + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", research.ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        stream = stream.select("session_id", F.timestamp_seconds(F.col("at") + F.lit(int(START.timestamp()))).alias("ts"), "kind", "topic").withWatermark("ts", "10 hours")
        found = research.research_decisions(stream, 30, 3, 3600)
        q = found.writeStream.format("memory").queryName("research").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").start()
        q.processAllAvailable()
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        q.stop()
        seconds = F.unix_timestamp("ts") - F.lit(int(START.timestamp()))
        got = sorted((r.session_id, r.at, r.topic, r.decision, r.done, tuple(r.remembered)) for r in spark.table("research").withColumn("at", seconds).collect())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = by_hand(events, 30, 3, 3600)
    assert got == want
    assert {r[3] for r in want} == {"start", "running", "early", "full", "done", "failed"}
    assert left <= 6  # sessions whose run never ended, and the last
