"""Structured Streaming: limits, throttles, windows and sinks of the ingest path.

Stateful functions keep a few numbers per key and time out, so state stays as large as the
set of keys that are active. Within a micro-batch a key's events are taken in time order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.operators.incremental import Lease

WINDOW_SECONDS, MOST_REQUESTS = 60, 120
MOST_FETCHES = 10
TOPIC_GAP_SECONDS, MOST_TOPICS, IDLE_SECONDS = 30, 50, 3600
BATCH_ROWS, MOST_TRIES, MOST_QUEUED = 10, 3, 1000


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values("ts", kind="stable", ignore_index=True)


def rate_limited(requests: DataFrame, seconds: int = WINDOW_SECONDS, most: int = MOST_REQUESTS) -> DataFrame:
    """(key, ts, allowed) of a stream (key, ts): ``most`` requests in a window that starts at its first request."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows, allowed = _ordered(frames), []
        for ts in rows["ts"]:
            now = ts.timestamp()
            if start is None or now - start >= seconds:
                start, count = now, 0
            count += 1
            allowed.append(count <= most)
        state.update((start, count))
        state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "allowed": allowed})

    return requests.groupBy("key").applyInPandasWithState(
        step, "key string, ts timestamp, allowed boolean", "start double, count long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def research_throttled(topics: DataFrame, gap: int = TOPIC_GAP_SECONDS, most: int = MOST_TOPICS, idle: int = IDLE_SECONDS) -> DataFrame:
    """(session_id, ts, topic) of a stream of those: at least ``gap`` seconds apart and ``most`` per session,
    which begins anew after ``idle`` seconds without a topic. Needs a watermark on ts."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen, count = state.get if state.exists else (None, None, 0)
        rows, taken = _ordered(frames), []
        for ts in rows["ts"]:
            now = ts.timestamp()
            if seen is not None and now - seen > idle:
                last, count = None, 0
            ok = (last is None or now - last >= gap) and count < most
            if ok:
                last, count = now, count + 1
            seen = now
            taken.append(ok)
        state.update((last if last is not None else -1e18, seen, count))
        state.setTimeoutTimestamp(max(int((seen + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows[taken].assign(session_id=key[0])[["session_id", "ts", "topic"]]

    return topics.groupBy("session_id").applyInPandasWithState(
        step,
        "session_id string, ts timestamp, topic string",
        "last double, seen double, count long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def fetch_limited(fetches: DataFrame, seconds: int = 60, most: int = MOST_FETCHES) -> DataFrame:
    """(key, ts, id, recent, allowed) of a batch (key, ts, id): ``recent`` are the key's allowed fetches in the ``seconds`` before.

    Refused fetches don't count, so each decision needs the ones before it: a key's rows go
    through one task in order of time, then id, with ``most`` times kept.
    """

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, deque()
        for batch in batches:
            recent, allowed = [], []
            for own, at in zip(batch["key"], batch["at"], strict=True):
                if own != key:
                    key, kept = own, deque()
                while kept and at - kept[0] > seconds * 1_000_000:
                    kept.popleft()
                recent.append(len(kept))
                allowed.append(len(kept) < most)
                if allowed[-1]:
                    kept.append(at)
            yield batch.drop(columns="at").assign(recent=recent, allowed=allowed)

    rows = fetches.select("key", "ts", "id", F.unix_micros("ts").alias("at")).repartition("key").sortWithinPartitions("key", "ts", "id")
    return rows.mapInPandas(step, "key string, ts timestamp, id long, recent long, allowed boolean")


def request_windows(requests: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(key, start, n) by aligned windows; works on batches and, with a watermark, on streams."""
    return requests.groupBy("key", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, idle: int = IDLE_SECONDS) -> DataFrame:
    """(key, start, end, n) of runs of events with no gap of ``idle`` seconds; end is the last event plus idle."""
    grouped = events.groupBy("key", F.session_window("ts", f"{idle} seconds").alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def embedding_sink(stream: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, tries: int = MOST_TRIES):
    """Start writing embedded rows: each micro-batch is embedded as a whole, with retries, and appended once.

    Bound the batches where the stream is read (maxFilesPerTrigger, maxRowsPerTrigger). Progress is in the
    checkpoint, so a lost process starts again at the batch it was at.
    """

    def one(batch: DataFrame, number: int) -> None:
        for attempt in range(tries):
            try:
                embed(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
                return
            except Exception:
                if attempt + 1 == tries:
                    raise

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def embed_queue(
    stream: DataFrame, embed: Callable[[list[str]], list[list[float]]], path: str, checkpoint: str, most: int = MOST_QUEUED, size: int = BATCH_ROWS, tries: int = MOST_TRIES
):
    """Start writing vectors of a stream (id, text): ``size`` texts at a time, each row once, whatever fails.

    Of a micro-batch the first ``most`` ids are embedded, the others are dropped as from a full queue. A call
    that fails is tried ``tries`` times; if it still fails, its rows are tried one by one, and those that fail are dead
    letters. Everything of micro-batch N is in ``batch=N`` of the folders ``vectors``, ``dead`` and ``dropped``, which is
    written over if it is run again, so a lost process starts at the batch it was at and nothing is there twice.
    ``ledger`` has a row for each finished batch; batches without one are not to be read.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def tried(texts: list[str]) -> list[list[float]]:
            for attempt in range(tries):
                try:
                    return embed(texts)
                except Exception:
                    if attempt + 1 == tries:
                        raise

        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                try:
                    yield pd.DataFrame({"id": part["id"], "v": tried(part["text"].tolist()), "error": None})
                    continue
                except Exception:  # which of them is it?
                    pass
                for i, text in zip(part["id"], part["text"], strict=True):
                    try:
                        yield pd.DataFrame({"id": [i], "v": tried([text]), "error": [None]})
                    except Exception as failure:
                        yield pd.DataFrame({"id": [i], "v": [None], "error": [f"{type(failure).__name__}: {failure}"]})

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        queued = batch.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).persist()
        try:
            last = queued.orderBy("id").limit(most).agg(F.max("id"), F.count("*")).first()
            taken = queued.where(F.col("id") <= F.lit(last[0])) if last[1] else queued
            done = taken.mapInPandas(rows, "id long, v array<double>, error string")
            done.write.mode("overwrite").parquet(f"{path}/made/batch={number}")
            done = spark.read.schema("id long, v array<double>, error string").parquet(f"{path}/made/batch={number}")
            done.where("v IS NOT NULL").select("id", "v").write.mode("overwrite").parquet(f"{path}/vectors/batch={number}")
            done.where("v IS NULL").select("id", "error").write.mode("overwrite").parquet(f"{path}/dead/batch={number}")
            queued.where(F.col("id") > F.lit(last[0])).select("id").write.mode("overwrite").parquet(f"{path}/dropped/batch={number}")
            spark.createDataFrame([(number, last[1])], "number long, taken long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")
        finally:
            queued.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def embedded(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) of the finished batches of ``embed_queue``; the last of an id that came again."""
    found = spark.read.option("basePath", f"{path}/vectors").parquet(f"{path}/vectors")
    ledger = spark.read.option("basePath", f"{path}/ledger").parquet(f"{path}/ledger").select("batch")
    return found.join(F.broadcast(ledger), "batch", "left_semi").groupBy("id").agg(F.max_by("v", "batch").alias("v"))


def maintenance_loop(stream: DataFrame, run: Callable[[], None], checkpoint: str, every: str = "5 minutes", lease: Lease | None = None):
    """Start calling ``run`` after micro-batches with rows, one at a time and not more often than ``every``.

    With a lease, a run that another process is at is left to it; the rows are then seen by
    the next one, as ``run`` looks at all that has changed.
    """

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty() or (lease is not None and not lease.take()):
            return
        try:
            run()
        finally:
            if lease is not None:
                lease.give()

    return stream.writeStream.foreachBatch(one).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()
