"""Request limits over stored events: what a server would have decided one request after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.adjacent import next_at
from recollect.session import written

WINDOW_SECONDS, MOST_REQUESTS = 60, 120


def window_starts(requests: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(key, us) of the requests (key, us) that begin a window: a key's first, and each first that comes ``seconds`` after the start before.

    Every request knows the one that would begin the next window if it began one itself. From a
    key's first request these pointers lead to all starts; as they double in every round, a key
    with n windows takes log2(n) rounds and no pass over its requests in order.
    """
    times = written(requests.select("key", "us").where("key IS NOT NULL AND us IS NOT NULL").distinct(), "request-times")
    probes = times.select("key", (F.col("us") + seconds * 1_000_000).alias("at"), "us")
    jump = next_at(times.select("key", F.col("us").alias("at")), probes, "key", "at", "to").where("to IS NOT NULL").select("key", "us", "to")
    jump = written(jump, "window-jumps")
    starts = written(times.groupBy("key").agg(F.min("us").alias("us")), "window-starts")
    while True:
        led = written(starts.join(jump, ["key", "us"]).select("key", F.col("to").alias("us")), "window-starts")
        if led.isEmpty():
            return starts
        starts = starts.unionByName(led)
        further = jump.select("key", F.col("us").alias("to"), F.col("to").alias("then"))
        jump = written(jump.join(further, ["key", "to"]).select("key", "us", F.col("then").alias("to")), "window-jumps")


def rate_limited(requests: DataFrame, seconds: int = WINDOW_SECONDS, most: int = MOST_REQUESTS) -> DataFrame:
    """(key, ts, id, start, allowed) of requests (key, ts, id), ids unique: ``most`` are allowed in each window, in order of time, then id.

    A window lasts ``seconds`` from its first request, as the limiter of a stream has it
    (``streaming.ingest.rate_limited``). Requests without a key or time are left out.
    """
    rows = requests.select("key", "ts", "id", F.unix_micros("ts").alias("us")).where("key IS NOT NULL AND us IS NOT NULL")
    starts = written(window_starts(rows, seconds), "window-starts")
    # the last start that is not after a request: the next one, counted backwards
    back = next_at(starts.select("key", (-F.col("us")).alias("at")), rows.select("key", (-F.col("us")).alias("at"), "ts", "id"), "key", "at", "start")
    placed = written(back.select("key", "ts", "id", (-F.col("start")).alias("start")), "placed-requests")
    nth = F.row_number().over(Window.partitionBy("key", "start").orderBy("ts", "id"))
    first = placed.withColumn("nth", nth).where(F.col("nth") <= most).select("id", F.lit(True).alias("allowed"))
    return placed.join(first, "id", "left").select("key", "ts", "id", F.timestamp_micros("start").alias("start"), F.coalesce("allowed", F.lit(False)).alias("allowed"))
