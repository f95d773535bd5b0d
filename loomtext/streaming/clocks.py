"""Streams of model output with event-time timers and keyed state.

``stream_ends`` gives every stream one overall deadline from its first chunk and
every ended stream one expiry from its end, whatever comes later: neither is put
off by activity. Timers fire when the watermark passes them; what is decided by
event time does not wait for them, so a chunk behind the deadline is late even if
it comes before the timer. ``operators.streams.stream_ends`` is the batch form.

``slide_stream`` cuts streams of chunks into texts and slides as they come; a
chunk that is null ends its stream. What it returns does not depend on how the
text is cut into chunks, beyond neighbouring texts being one or several.

State is kept by RocksDB, which ``with_timers`` sets for a session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from loomtext.functions.segments import Segmenter

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENDS = "stream_id string, event string, at long, started long, chunks long, late long"
SLIDES = "stream_id string, event long, kind string, slide int, value string"


def with_timers(spark: SparkSession) -> SparkSession:
    """``spark`` with the state store that timers and keyed state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class Ends(StatefulProcessor):
    """State: first chunk, end (or -1), how it ended, chunks up to it and behind it."""

    def __init__(self, timeout_ms: int, ttl_ms: int, known_ms: int):
        self.timeout, self.ttl, self.known = timeout_ms, ttl_ms, known_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("ends", "started long, ended long, status string, chunks long, late long")

    def row(self, key, event: str, at: int, state: tuple) -> pd.DataFrame:
        return pd.DataFrame({"stream_id": [key[0]], "event": [event], "at": [at], "started": [state[0]], "chunks": [state[3]], "late": [state[4]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["at", "done"], kind="stable")
        started, ended, status, chunks, late = self.kept.get() if self.kept.exists() else (-1, -1, "", 0, 0)
        for at, done in zip(own["at"].tolist(), own["done"].tolist()):
            if started < 0:
                started = at
                self.handle.registerTimer(started + self.timeout)
            if ended < 0 and at > started + self.timeout:
                ended, status = started + self.timeout, "timed out"
                self.handle.registerTimer(ended + self.ttl)
                yield self.row(key, status, ended, (started, ended, status, chunks, late))
            if ended >= 0:
                late += status != "expired" and at <= ended + self.ttl
                continue
            chunks += 1
            if done:
                ended, status = at, "done"
                self.handle.deleteTimer(started + self.timeout)
                self.handle.registerTimer(ended + self.ttl)
                yield self.row(key, status, ended, (started, ended, status, chunks, late))
        self.kept.update((started, ended, status, chunks, late))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.kept.exists():
            return
        started, ended, status, chunks, late = self.kept.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if ended < 0 and at == started + self.timeout:
            self.kept.update((started, at, "timed out", chunks, late))
            self.handle.registerTimer(at + self.ttl)
            yield self.row(key, "timed out", at, (started, at, "timed out", chunks, late))
        elif ended >= 0 and status == "expired":
            self.kept.clear()
        elif ended >= 0 and at == ended + self.ttl:
            self.kept.update((started, ended, "expired", chunks, late))
            self.handle.registerTimer(at + self.known)
            yield self.row(key, "expired", at, (started, ended, status, chunks, late))

    def close(self) -> None:
        pass


def stream_ends(chunks: DataFrame, timeout_ms: int, ttl_ms: int, late: str = "1 minute", known_ms: int = 86_400_000) -> DataFrame:
    """(stream_id, event, at, started, chunks, late): ``done`` or ``timed out`` and
    later ``expired`` of every stream of ``chunks`` (stream_id, ts, done). What comes
    behind the expiry is dropped; for ``known_ms`` more an expired id stays known,
    then its state goes and the id may be used again."""
    own = chunks.withWatermark("ts", late).selectExpr("stream_id", "ts", "unix_millis(ts) AS at", "done")
    return own.groupBy("stream_id").transformWithStateInPandas(Ends(timeout_ms, ttl_ms, known_ms), ENDS, "append", "eventTime")


class Slides(StatefulProcessor):
    """State: the segmenter's, as JSON, and the number of events."""

    def __init__(self, expected: int):
        self.expected = expected

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("slides", "state string, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        state, n = self.kept.get() if self.kept.exists() else (None, 0)
        own, out = Segmenter(json.loads(state) if state else None), []
        chunks = pd.concat(list(rows)).sort_values("seq", kind="stable")["chunk"].tolist()
        ended = None in chunks
        for chunk in chunks[: chunks.index(None)] if ended else chunks:
            out += own.feed(chunk)
        if ended:
            out += own.finish(range(1, self.expected + 1))
            self.kept.clear()
        else:
            self.kept.update((json.dumps(own.state()), n + len(out)))
        if out:
            yield pd.DataFrame({"stream_id": key[0], "event": range(n, n + len(out)), "kind": [e[0] for e in out], "slide": pd.array([e[1] for e in out], "Int32"), "value": [e[2] for e in out]})

    def close(self) -> None:
        pass


def slide_stream(chunks: DataFrame, expected: int = 0) -> DataFrame:
    """(stream_id, event, kind, slide, value) for a stream of (stream_id, seq, chunk)."""
    return chunks.groupBy("stream_id").transformWithStateInPandas(Slides(expected), SLIDES, "append", "none")
