"""Stitching a stream of model output with state by stream id.

State is the text so far, kept in the state store; a stream id expires after
``timeout`` without chunks. Within a micro-batch chunks go in order of ``seq``; a
chunk that comes late is treated as a regression, as the fold does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtext.functions.scan import merge_chunk


def stitched(chunks: DataFrame, timeout: str = "15 minutes") -> DataFrame:
    """(stream_id, seq, text, appended) for a stream of (stream_id, seq, chunk)."""
    minutes = int(timeout.split()[0])

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        text = state.get[0] if state.exists else ""
        rows = pd.concat(batches).sort_values("seq", kind="stable")
        out = []
        for seq, chunk in zip(rows["seq"], rows["chunk"]):
            text, added = merge_chunk(text, chunk or "")
            out.append((key[0], seq, text, added))
        state.update((text,))
        state.setTimeoutDuration(minutes * 60_000)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text", "appended"])

    return chunks.groupBy("stream_id").applyInPandasWithState(fold, "stream_id string, seq long, text string, appended string", "text string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling windows, late events bounded by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def live_after(live: DataFrame, snapshot: DataFrame, key: str, seq: str) -> DataFrame:
    """Of a stream of events those behind a stored snapshot of them: with the
    snapshot in front each event comes once, however far the two overlap. The
    cut of a key is its largest ``seq`` in the snapshot, which must have all before it."""
    cut = snapshot.groupBy(F.col(key).alias("key_")).agg(F.max(seq).alias("cut_"))
    return live.join(cut, F.col(key) == F.col("key_"), "left").where(F.col("cut_").isNull() | (F.col(seq) > F.col("cut_"))).drop("key_", "cut_")
