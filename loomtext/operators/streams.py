"""Batch forms of what happens to streams of model output: folds by key in order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from loomtext.functions import payloads, scan, segments
from loomtext.operators.folds import folded


class Merge:
    """One session's text so far, the only thing that is kept of it."""

    def __init__(self):
        self.text = ""

    def step(self, at, chunk: str | None) -> list[tuple]:
        self.text, new = scan.merge_chunk(self.text, chunk or "")
        return [(at, new, len(self.text))]

    def finish(self) -> list[tuple]:
        return []


def merged_chunks(chunks: DataFrame, key: str, order: str, chunk: str) -> DataFrame:
    """(key, order, appended, total): what each chunk adds to its session's text and
    the characters that text has then. Chunks that share their place go by themselves."""
    kind = chunks.schema[order].dataType.simpleString()
    return folded(chunks, key, [order, chunk], [order, chunk], Merge, f"`{order}` {kind}, appended string, total long")


class Slides:
    """A session's segmenter; events are numbered from 0."""

    def __init__(self):
        self.own, self.count, self.most = segments.Segmenter(), 0, 0

    def numbered(self, events: list[segments.Event]) -> list[tuple]:
        out = [(self.count + i, *e) for i, e in enumerate(events)]
        self.count += len(out)
        return out

    def step(self, chunk: str | None, expected: int | None) -> list[tuple]:
        self.most = max(self.most, expected or 0)
        return self.numbered(self.own.feed(chunk))

    def finish(self) -> list[tuple]:
        return self.numbered(self.own.finish(range(1, self.most + 1)))


def slide_events(chunks: DataFrame, key: str, order: list[str], chunk: str, expected: str) -> DataFrame:
    """(key, event, kind, slide, value): texts (kind ``text``) and slides with their
    titles (kind ``slide``) of each session's chunks, then the slides up to
    ``expected`` that no marker named. See ``functions.segments``."""
    return folded(chunks, key, order, [chunk, expected], Slides, "event long, kind string, slide int, value string")


def slide_parts(events: DataFrame, key: str) -> DataFrame:
    """(key, part, slide, title, text) of ``slide_events``: what stands before the
    first slide is part 0, each slide with what follows it another."""
    own = Window.partitionBy(key).orderBy("event")
    parts = events.withColumn("part", F.sum((F.col("kind") == "slide").cast("int")).over(own))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("event", "value")))), lambda x: x["value"]), "")
    return parts.groupBy(key, "part").agg(F.max("slide").alias("slide"), F.max(F.when(F.col("kind") == "slide", F.col("value"))).alias("title"), said.alias("text"))


def stream_ends(chunks: DataFrame, timeout_ms: int, ttl_ms: int) -> DataFrame:
    """(stream_id, status, ended, expires, started, chunks, late, gone) of ``chunks``
    (stream_id, at, done). A stream starts with its first chunk, ends with its first
    done one or, if none comes by then, ``timeout_ms`` behind its start, and expires
    ``ttl_ms`` behind its end, whatever comes later; chunks behind the end are late,
    those behind the expiry gone. Of chunks of one time those that are done come
    last. Aggregations that combine before their shuffle, and joins on their results."""
    rows = chunks.select("stream_id", "at", F.coalesce("done", F.lit(False)).alias("done"))

    def with_key(known: DataFrame) -> DataFrame:
        return rows.join(known.withColumnRenamed("stream_id", "s_"), F.col("stream_id").eqNullSafe(F.col("s_"))).drop("s_")

    due = F.col("started") + timeout_ms
    started = rows.groupBy("stream_id").agg(F.min("at").alias("started"))
    done_at = with_key(started).groupBy("stream_id", "started").agg(F.min(F.when(F.col("done") & (F.col("at") <= due), F.col("at"))).alias("done_at"))
    ends = done_at.select("stream_id", "started", F.coalesce("done_at", due).alias("ended"), F.when(F.col("done_at").isNotNull(), "done").otherwise("timed out").alias("status"))
    # of the chunks at the end itself, one that is done has ended the stream and the plain ones were in time
    at_end = (F.col("at") == F.col("ended")) & ~(F.col("done") & (F.col("status") == "done"))
    gone = F.count_if(F.col("at") > F.col("ended") + ttl_ms)
    out = with_key(ends).groupBy("stream_id", "started", "ended", "status").agg(F.count_if((F.col("at") < F.col("ended")) | at_end).alias("n_"), F.count("*").alias("all_"), gone.alias("gone"))
    chunks_in = F.col("n_") + F.when(F.col("status") == "done", 1).otherwise(0)
    return out.select("stream_id", "status", "ended", (F.col("ended") + ttl_ms).alias("expires"), "started", chunks_in.alias("chunks"), (F.col("all_") - chunks_in - F.col("gone")).alias("late"), "gone")


class Throttle:
    """The time of the last update that was shown."""

    def __init__(self, gap: int):
        self.gap, self.last = gap, None

    def step(self, at, seq) -> list[tuple]:
        if at is None or self.last is not None and at - self.last < self.gap:
            return []
        self.last = at
        return [(at, seq)]

    def finish(self) -> list[tuple]:
        return []


def throttled(updates: DataFrame, key: str, at: str, seq: str, gap_ms: int = 100) -> DataFrame:
    """(key, at, seq) of the updates that are shown: a key's first, then each at least
    ``gap_ms`` behind the last one shown; updates without a time are not."""
    kinds = {f.name: f.dataType.simpleString() for f in updates.schema}
    return folded(updates, key, [at, seq], [at, seq], lambda: Throttle(gap_ms), f"`{at}` {kinds[at]}, `{seq}` {kinds[seq]}")


class EarlyEnd:
    """Bytes so far, the marks seen and a tail in which one may yet be completed."""

    def __init__(self, least: int, groups: tuple[tuple[str, ...], ...]):
        self.least, self.groups = least, groups
        self.open, self.tail, self.size, self.ended = {m for g in groups for m in g}, "", 0, False
        self.reach = max(map(len, self.open), default=1) - 1

    def step(self, order, chunk: str | None) -> list[tuple]:
        if self.ended:
            return []
        chunk = chunk or ""
        text = self.tail + chunk
        self.open -= {m for m in self.open if m in text}
        self.tail = text[max(0, len(text) - self.reach) :] if self.reach else ""
        self.size += len(chunk.encode())
        self.ended = self.size >= self.least and any(self.open.isdisjoint(g) for g in self.groups)
        return [(order, self.size, self.ended)]

    def finish(self) -> list[tuple]:
        return []


def early_ended(chunks: DataFrame, key: str, order: str, chunk: str, least: int, groups: tuple[tuple[str, ...], ...]) -> DataFrame:
    """(key, order, size, ended): the chunks that are read of each stream, which ends
    with the chunk by which ``least`` bytes have come and all marks of some group
    stand in the text so far, also across chunks; the others are never asked for.
    Without ``ended`` the stream was read to its own end."""
    kind = chunks.schema[order].dataType.simpleString()
    return folded(chunks, key, [order, chunk], [order, chunk], lambda: EarlyEnd(least, groups), f"`{order}` {kind}, size long, ended boolean")


def subscriptions(events: DataFrame, subscribers: DataFrame, key: str, most: int = 1_000_000, keepalive_ms: int = 15_000) -> DataFrame:
    """(subscriber, key, kind, seq, at) of what each of ``subscribers`` (subscriber, key,
    joined) receives of ``events`` (key, seq, at, size, last): first what the session's
    buffer holds when it joins, the newest events within ``most`` bytes, then what comes
    later, up to the session's last event; until then a sign of life after every
    ``keepalive_ms``. ``seq`` tells the events' order; who joins a session that has ended
    only gets the buffer."""
    ends = events.where("last").groupBy(key).agg(F.min("at").alias("end_"), F.min("seq").alias("last_"))
    known = events.join(ends, key, "left").where(F.col("last_").isNull() | (F.col("seq") <= F.col("last_")))
    rows = subscribers.join(known, key)
    held = F.sum("size").over(Window.partitionBy("subscriber", key, "old_").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("old_", F.col("at") <= F.col("joined")).withColumn("held_", held)
    sent = rows.where(~F.col("old_") | (F.col("held_") <= most)).select("subscriber", key, F.when(F.col("old_"), "replay").otherwise("live").alias("kind"), "seq", "at")
    spans = subscribers.join(known.groupBy(key).agg(F.max(F.coalesce("end_", "at")).alias("end_")), key).where(F.col("end_") > F.col("joined") + keepalive_ms)
    beats = spans.select("subscriber", key, F.lit("keepalive").alias("kind"), F.lit(None).cast("long").alias("seq"), F.explode(F.sequence(F.col("joined") + keepalive_ms, F.col("end_") - 1, F.lit(keepalive_ms).cast("long"))).alias("at"))
    return sent.unionByName(beats)


def gated(states: DataFrame, key: str, order: str, text: str, lines: bool) -> DataFrame:
    """(key, order, written): what an output writes for each state of the text."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pd.DataFrame({key: pdf[key], order: pdf[order], "written": scan.gate(list(pdf[text]), lines)})

    kinds = {f.name: f.dataType.simpleString() for f in states.schema}
    return states.groupBy(key).applyInPandas(fold, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, written string")


def session_meta(events: DataFrame, key: str, order: str, fields: tuple[str, ...]) -> DataFrame:
    """Each field's last value that is not null, by session: partial aggregation."""
    last = [F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return events.groupBy(key).agg(*last)


def open_events(events: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Events up to and with the first ``done`` or ``error`` of their session."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col(kind).isin("done", "error")).over(w), F.lit(False))
    return events.withColumn("ended_", ended).where("not ended_").drop("ended_")


def buffered(events: DataFrame, key: str, order: str, size: str, most: int = 1_000_000) -> DataFrame:
    """Of each session the newest events within ``most`` bytes."""
    w = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("held_", F.sum(size).over(w)).where(F.col("held_") <= most).drop("held_")


def log_ring(lines: DataFrame, key: str, order: str, line: str, most: int = 400, width: int = 2000) -> DataFrame:
    """The last ``most`` lines of each process, each cut to ``width``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return lines.withColumn(line, F.substring(line, 1, width)).withColumn("n_", n).where(F.col("n_") <= most).drop("n_")


def slide_state(updates: DataFrame, key: str, order: str) -> DataFrame:
    """(key, index, path, at): each slide's last path that is not blank and last time."""
    path = F.nullif(F.trim("path"), F.lit(""))
    return updates.groupBy(key, "index").agg(F.max_by(path, F.when(path.isNotNull(), F.col(order))).alias("path"), F.max_by("at", F.when(F.col("at").isNotNull(), F.col(order))).alias("at"))


def sse(events: DataFrame, name: str, data: str) -> DataFrame:
    return events.withColumn("message", payloads.sse_event(F.col(name), F.col(data)))
