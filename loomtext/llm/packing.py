"""Conflict-constrained best-fit packing.

A text is cut into pieces of at most ``CAPACITY`` code points; a full piece is a
bin of its own and the rest of the text is packed. No bin holds two pieces of
one source or of one duplicate cluster. Open bins are kept in the order of their
residual capacity and carry a bitmap of their sources and one of their clusters;
a piece, longest first, takes the first bin at or behind its length in that
order whose bitmaps have neither of its bits, and a new bin if there is none.

Pieces are packed in shards of about ``SHARD_ROWS`` rows, dealt by a hash of id
and text, so that no task depends on how ids, sources or clusters are spread;
only lengths and keys reach a shard. A bin never crosses shards.

Defined results: null and empty texts have no piece and are in no bin; a null
source or cluster conflicts with nothing; a row that repeats another of its
shard has its source and cluster, so it lies in another bin; ties in length go
by id, then source; no rows give no bins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

CAPACITY = 8192
SHARD_ROWS = 20_000


class OpenBins:
    """Bins by residual; bin k's bitmaps are rows k of two arrays of words."""

    def __init__(self, sources: int, clusters: int, look: int = 256):
        self.words = (max(1, -(-sources // 64)), max(1, -(-clusters // 64)))
        self.masks = [np.zeros((1024, w), np.uint64) for w in self.words]
        self.residual, self.bins = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.count, self.look = 0, look

    def find(self, size: int, bits: tuple[int, int]) -> int:
        """Place in the order of the tightest compatible bin, or -1."""
        at = int(np.searchsorted(self.residual, size))
        while at < len(self.bins):
            ids = self.bins[at : at + self.look]
            clash = np.zeros(len(ids), bool)
            for mask, bit in zip(self.masks, bits):
                if bit >= 0:
                    clash |= (mask[ids, bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)).astype(bool)
            if not clash.all():
                return at + int(clash.argmin())
            at += self.look
        return -1

    def put(self, size: int, bits: tuple[int, int], capacity: int) -> tuple[int, int]:
        """(bin, offset) that a piece gets."""
        at = self.find(size, bits)
        if at < 0:
            bin_, room = self.count, capacity
            self.count += 1
            if bin_ == len(self.masks[0]):
                self.masks = [np.concatenate([m, np.zeros_like(m)]) for m in self.masks]
        else:
            bin_, room = int(self.bins[at]), int(self.residual[at])
            self.residual, self.bins = np.delete(self.residual, at), np.delete(self.bins, at)
        for mask, bit in zip(self.masks, bits):
            if bit >= 0:
                mask[bin_, bit >> 6] |= np.uint64(1 << (bit & 63))
        if room > size:
            to = int(np.searchsorted(self.residual, room - size))
            self.residual, self.bins = np.insert(self.residual, to, room - size), np.insert(self.bins, to, bin_)
        return bin_, capacity - room


def numbers(keys: list, only_repeated: bool) -> list[int]:
    """A bit for each key that can conflict, -1 for the others."""
    seen = pd.Series(keys, dtype=object)
    counts = seen.value_counts()
    held = {k: i for i, k in enumerate(counts.index[counts > 1] if only_repeated else counts.index)}
    return [held.get(k, -1) if k is not None else -1 for k in keys]


def pack_shard(ids: list, sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each piece; bins are numbered in the order they open."""
    a, b = numbers(sources, True), numbers(clusters, True)
    bins = OpenBins(max(a, default=-1) + 1, max(b, default=-1) + 1)
    order = sorted(range(len(ids)), key=lambda i: (-sizes[i], ids[i] is None, ids[i], sources[i] or ""))
    to, at = [0] * len(ids), [0] * len(ids)
    for i in order:
        to[i], at[i] = bins.put(sizes[i], (a[i], b[i]), capacity)
    return to, at


def text_cluster(text: Column) -> Column:
    """Duplicate cluster of a text: its words, lower-cased."""
    return F.xxhash64(F.lower(F.regexp_replace(text, r"\s+", " ")))


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """Two hashes, never null, that rows share only if id and text are equal."""
    return [F.xxhash64(F.col(id_col).isNull(), id_col).alias("id_key"), F.xxhash64(text_col).alias("text_key")]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, keyed: bool = True) -> DataFrame:
    """(id, piece, start, end, shard, bin, offset, bin_id) of every piece: the
    code points [start, end) of a text lie at ``offset`` of bin ``bin_id``. With
    ``keyed``, its row's keys too, by which ``packed_texts`` finds the text."""
    named = ["id_key", "text_key"] if keyed else []
    cluster = text_cluster(F.col(text_col)) if cluster is None else cluster
    rows = docs.where(F.length(text_col) > 0)
    shards = max(1, -(-docs.count() // shard_rows))
    rows = rows.select(
        F.col(id_col).alias("id"), F.length(text_col).alias("n"), F.col(source_col).cast("string").alias("source"), cluster.cast("long").alias("cluster"),
        F.pmod(F.xxhash64(F.lit("shard"), id_col, text_col), F.lit(shards)).cast("int").alias("shard"),
        *(row_keys(id_col, text_col) if keyed else []),
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, full = int(pdf["shard"].iloc[0]), pdf["n"].to_numpy() // capacity
        rest = pdf["n"].to_numpy() % capacity
        some = np.flatnonzero(rest)
        keys = lambda col: [None if pd.isna(x) else x for x in pdf[col].iloc[some]]
        to, offset = pack_shard(keys("id"), rest[some].tolist(), keys("source"), keys("cluster"), capacity)
        first = max(to, default=-1) + 1
        owner = np.repeat(np.arange(len(pdf)), full)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        at = np.concatenate([owner, some])
        piece = np.concatenate([piece, full[some]])
        out = pd.DataFrame({"id": pdf["id"].to_numpy()[at], "piece": piece, "start": piece * capacity})
        out["id"] = pdf["id"].iloc[at].array
        out["end"] = np.minimum(out["start"] + capacity, pdf["n"].to_numpy()[at])
        out["shard"] = shard
        out["bin"] = np.concatenate([first + np.arange(len(owner)), np.array(to, np.int64)]).astype(np.int64)
        out["offset"] = np.concatenate([np.zeros(len(owner), np.int64), np.array(offset, np.int64)])
        out["bin_id"] = out["bin"] * shards + shard
        for col in named:
            out[col] = pdf[col].to_numpy()[at]
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start int, end int, shard int, bin long, offset int, bin_id long" + "".join(f", {col} long" for col in named)
    return rows.groupBy("shard").applyInPandas(run, schema).withColumnRenamed("id", id_col)


def packed_texts(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n\n") -> DataFrame:
    """(bin_id, doc_ids, n_chars, text): the bins, their pieces in order of
    offset joined by ``separator``. ``pieces`` are keyed. Ids may be null or
    repeated: rows of one id and text are alike, so each piece takes its text
    from any of them, and the others do not multiply it."""
    keys = ["id_key", "text_key"]
    texts = docs.where(F.length(text_col) > 0).select(*row_keys(id_col, text_col), id_col, text_col)
    texts = texts.groupBy(keys).agg(F.first(id_col).alias(id_col), F.first(text_col).alias(text_col))
    parts = pieces.drop(id_col).join(texts, keys)
    parts = parts.select("bin_id", "offset", F.col(id_col).alias("id"), F.expr("end - start").alias("n"), F.expr(f"substring(`{text_col}`, start + 1, end - start)").alias("part"))
    bins = parts.groupBy("bin_id").agg(F.array_sort(F.collect_list(F.struct("offset", "id", "n", "part"))).alias("parts"))
    total = F.aggregate("parts", F.lit(0), lambda a, p: a + p["n"])
    return bins.select("bin_id", F.col("parts.id").alias("doc_ids"), F.col("parts.offset").alias("offsets"), total.alias("n_chars"), F.array_join("parts.part", separator).alias("text"))
