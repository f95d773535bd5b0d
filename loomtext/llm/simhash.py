"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint is the bitwise majority of the XXH64 of its word shingles.
Distinct fingerprints are indexed once for each segment of their bits. Two
fingerprints at distance 4 or less agree to within the radius of some segment
as long as the radii plus the number of segments exceed 4, so with four
16-bit segments radii (1, 0, 0, 0) miss nothing: every fingerprint is stored under
its segments and looked up under the Hamming ball of each. Matches are verified on all 64 bits. Buckets of over
``BUCKET_ROWS`` rows are cut into blocks and every pair of blocks is compared in
a task of its own, so no pair is lost and no task holds a whole hot bucket. A
task hands on a spanning forest of what it found, never all its pairs.

Fewer, wider segments suit larger tables: their number follows from the count of
distinct fingerprints, so that chance fills a bucket with no more than
``BY_CHANCE`` of them; it never changes the result.

Defined results: null, empty and blank texts have fingerprint zero and link
like any other; equal rows share a component; a null id takes no part in
linking and has a null component; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from loomtext.llm.components import connected_components
from loomtext.llm.rows import map_slices
from loomtext.llm.shared import cut

SEED = 42
SHINGLE = 4
DISTANCE = 4
BY_CHANCE = 64
BUCKET_ROWS = 20_000
PAIRS_AT_ONCE = 4_000_000
EDGES_AT_ONCE = 1_000_000


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    words = (data or b"").lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    if n == 1:
        return digest(text, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = [digest(text[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""

    def make():
        return lambda ids, texts: {id_col: ids, "fp": [signed(fingerprint(t, shingle)) for t in texts]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(id_col, F.col(text_col).cast("binary")), make, f"`{id_col}` {kind}, fp long")


def segments_of(n: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment, the radii being as small as the
    pigeonhole principle allows and the wider segments first."""
    widths = [64 // n + (k < 64 % n) for k in range(n)]
    radii = [0] * n
    for k in range(max(0, distance + 1 - n)):
        radii[k % n] += 1
    shifts = np.cumsum([0, *widths])[:-1].tolist()
    return list(zip(shifts, widths, radii))


def flips(width: int, radius: int) -> list[int]:
    """Masks of 1 to ``radius`` bits."""
    out, last = [], [0]
    for _ in range(radius):
        last = sorted({m | 1 << b for m in last for b in range(width) if not m >> b & 1})
        out += last
    return out


def entries(fps: DataFrame, segments: int, distance: int) -> DataFrame:
    """(key, home) and the columns of ``fps`` (fp, ...): where each is stored (home) and looked up."""
    at = []
    for k, (shift, width, radius) in enumerate(segments_of(segments, distance)):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        tag = F.lit(k << 58)
        at.append(F.array(F.struct(value.bitwiseOR(tag).alias("key"), F.lit(True).alias("home"))))
        if masks := flips(width, radius):
            at.append(F.array(*(F.struct(value.bitwiseXOR(F.lit(m).cast("long")).bitwiseOR(tag).alias("key"), F.lit(False).alias("home")) for m in masks)))
    return fps.select(F.explode(F.concat(*at)).alias("e"), *fps.columns).select("e.key", "e.home", *fps.columns)


def blocks(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` with ``cell``: 0, or for a key of over ``limit`` rows the pairs of
    blocks that a row takes part in. There are at most as many such keys as
    rows / limit, and never more than the keys of all segments."""
    hot = F.broadcast(rows.groupBy("key").count().where(F.col("count") > limit).select("key", F.ceil(F.col("count") / limit).cast("int").alias("n")))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    cells = F.when(F.col("n").isNull(), F.array(F.struct(F.lit(0).alias("cell"), F.col("home").alias("home"))))
    each = F.sequence(F.lit(0), F.col("n") - 1)
    stored = F.transform(each, lambda j: F.struct((own * F.col("n") + j).alias("cell"), F.lit(True).alias("home")))
    looked = F.transform(each, lambda i: F.struct((i * F.col("n") + own).alias("cell"), F.lit(False).alias("home")))
    cells = cells.when(F.col("home"), F.concat(stored, looked)).otherwise(looked)
    return rows.join(hot, "key", "left").select("key", F.explode(cells).alias("c"), "fp").select("key", "c.cell", "c.home", "fp")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every node to the smallest node of its component."""
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, parent = flat[: len(u)], flat[len(u) :], np.arange(len(ids))
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low < high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(parent, high[open_], low[open_])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    away = parent != np.arange(len(ids))
    return ids[parent[away]], ids[away]


def bucket_links(fp: np.ndarray, home: np.ndarray, group: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within groups (``group`` ascending): each row against its group's
    stored rows, in blocks of at most about PAIRS_AT_ONCE pairs."""
    order = np.lexsort((~home, group))
    fp, home, group = fp[order], home[order], group[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    stored = np.add.reduceat(home.astype(np.int64), first)
    start, count = np.repeat(first, size), np.repeat(stored, size)
    total = np.cumsum(count)
    at = 0
    while at < len(fp):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, "right")))
        n = count[at:end]
        if pairs := int(n.sum()):
            a = np.repeat(np.arange(at, end), n)
            b = np.arange(pairs) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:end], n)
            near = (np.bitwise_count(fp[a] ^ fp[b]) <= distance) & (fp[a] < fp[b])
            if near.any():
                yield fp[a[near]], fp[b[near]]
        at = end


def segments_for(count: int, most: int = 4) -> int:
    """The most segments in whose buckets chance puts no more than ``BY_CHANCE`` of ``count`` fingerprints."""
    return next((n for n in range(most, 2, -1) if count <= BY_CHANCE << 64 // n), 2)


def links(fps: DataFrame, segments: int, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) between distinct ``fps`` (fp), enough to connect all that lie
    within ``distance``."""
    rows = blocks(entries(fps.select("fp"), segments, distance), bucket_rows)
    rows = rows.repartition("key", "cell").sortWithinPartitions("key", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        us, vs, held = [], [], 0

        def work(parts):
            nonlocal us, vs, held
            key, cell, home, fp = (np.concatenate(x) for x in zip(*parts))
            group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
            for u, v in bucket_links(fp.view(np.uint64), home, group, distance):
                us.append(u.view(np.int64))
                vs.append(v.view(np.int64))
                held += len(u)
                if held > EDGES_AT_ONCE:
                    u, v = forest(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], 0

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            key, cell = cols[0], cols[1]
            if not len(key):
                continue
            # whole groups only: the last one may go on in the next batch
            last = int(np.flatnonzero((key != key[-1]) | (cell != cell[-1]))[-1]) + 1 if (key[0], cell[0]) != (key[-1], cell[-1]) else 0
            if kept and (kept[-1][0][-1] != key[0] or kept[-1][1][-1] != cell[0] or last):
                work([*kept, [c[:last] for c in cols]] if last else kept)
                kept = []
            elif last:
                work([[c[:last] for c in cols]])
            kept.append([c[last:] for c in cols])
        if kept:
            work(kept)
        if us:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, segments: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    fps = cut(marked.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("rep")))
    parts = connected_components(links(fps, segments or segments_for(fps.count()), distance, bucket_rows))
    known = fps.join(parts, fps["fp"] == parts["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = cut(known.join(least, "component").select("fp", "component_id"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    out = marked.join(classes, "fp", "left")
    return out.select(id_col, shown.alias("fingerprint"), F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))
