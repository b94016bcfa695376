"""The research throttle with state of its own kind: values, lists and timers in RocksDB."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recollect.streaming.ingest import IDLE_SECONDS, MOST_TOPICS, TOPIC_GAP_SECONDS

MOST_REMEMBERED = 10
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISIONS = "session_id string, ts timestamp, topic string, decision string, done long, remembered array<string>"


class ResearchThrottle(StatefulProcessor):
    """Decides over a session's events (ts, kind, topic), in order of time.

    ``ask`` starts a run unless one is running (``running``), the last began less than ``gap`` seconds ago (``early``) or
    ``most`` have been done (``full``). ``done`` ends the run and adds its topic, ``failed`` only ends it. A session
    whose last run began over ``idle`` seconds ago is forgotten but for a run that goes on.
    """

    def __init__(self, gap: int = TOPIC_GAP_SECONDS, most: int = MOST_TOPICS, idle: int = IDLE_SECONDS):
        self.gap, self.most, self.idle = gap, most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "running boolean, last double, done long")
        self.topics = handle.getListState("topics", "topic string")

    def _forget(self, running: bool) -> tuple:
        self.topics.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if running:
            return (True, None, 0)
        self.now.clear()
        return (False, None, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "kind"], kind="stable")
        running, last, done = self.now.get() if self.now.exists() else (False, None, 0)
        out = []
        for ts, kind, topic in zip(events["ts"], events["kind"], events["topic"], strict=True):
            at = ts.timestamp()
            if last is not None and at - last > self.idle:
                running, last, done = self._forget(running)
            if kind == "ask":
                decision = "running" if running else "early" if last is not None and at - last < self.gap else "full" if done >= self.most else "start"
                if decision == "start":
                    running, last = True, at
            else:
                decision, running = kind, False
                if kind == "done":
                    done += 1
                    kept = [t[0] for t in self.topics.get()] if self.topics.exists() else []
                    self.topics.put([(t,) for t in [*kept, topic][-MOST_REMEMBERED:]])
            remembered = [t[0] for t in self.topics.get()] if self.topics.exists() else []
            out.append((key[0], ts, topic, decision, done, remembered))
        if running or last is not None or done:
            self.now.update((running, last, done))
            if last is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
                self.handle.registerTimer(max(int((last + self.idle) * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "ts", "topic", "decision", "done", "remembered"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        running = self.now.exists() and self.now.get()[0]
        state = self._forget(running)
        if running:
            self.now.update(state)
        yield pd.DataFrame([], columns=["session_id", "ts", "topic", "decision", "done", "remembered"])

    def close(self) -> None:
        pass


def research_decisions(events: DataFrame, gap: int = TOPIC_GAP_SECONDS, most: int = MOST_TOPICS, idle: int = IDLE_SECONDS) -> DataFrame:
    """DECISIONS of a stream (session_id, ts, kind, topic) with a watermark on ts; what comes later than it is left out.

    State is kept in RocksDB, so it may be larger than memory: set spark.sql.streaming.stateStore.providerClass to ``ROCKSDB``.
    """
    return events.groupBy("session_id").transformWithStateInPandas(ResearchThrottle(gap, most, idle), DECISIONS, "Append", "EventTime")
