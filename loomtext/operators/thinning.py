"""Times kept at least a gap behind the last one kept, over rows.

Which time is kept depends on the one kept before it, so a fold over one sorted
array would do, if a key's times fitted into one row. Here every time points to
its successor, the first time at least the gap behind it, and what the first
time of a key reaches is kept. Successors come from one range sort of all times
and of all times moved on by the gap, with running counts in its partitions moved
on by those of the partitions before; what is reached comes from pointer doubling, a
logarithm of the longest chain in rounds. Every join is on a unique number, so one
key may hold all rows. The driver sees one row of each partition and counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

from loomtext.sources.stored import stored

_PRUNE = 2


def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(key, at, own, part) with ``n``, this row's number among its kind in the partition,
    ``ahead``, the times seen before it there, and whether the last of those has its key."""
    times = probes = 0
    last: pa.Scalar | None = None
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        key, own = batch.column(0), np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
        differs = pc.fill_null(pc.not_equal(key[1:], key[:-1]), pc.xor(pc.is_null(key[1:]), pc.is_null(key[:-1])))
        group = np.concatenate([[0], np.cumsum(np.asarray(differs.to_numpy(zero_copy_only=False), bool))])
        latest = np.maximum.accumulate(np.where(own, np.arange(size), -1))
        known = latest >= 0
        same = np.where(known, group[latest] == group, False)
        if last is None:
            before = pa.array(same, mask=~known)
        else:
            before = pa.array(np.where(known, same, (group == 0) & (key[0].as_py() == last.as_py())))
        ahead = times + np.cumsum(own)
        n = np.where(own, ahead, probes + np.cumsum(~own))
        yield pa.RecordBatch.from_arrays([key, batch.column(1), batch.column(2), batch.column(3), pa.array(n), pa.array(ahead), before], schema=schema)
        times, probes = int(ahead[-1]), probes + int((~own).sum())
        if own.any():
            last = key[int(np.flatnonzero(own)[-1])]


def successors(times: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """(node, key, at, next) of every distinct time: its number, and that of the first
    time of its key at least ``gap`` behind it, null if there is none. Numbers fall
    with time; stored."""
    kind = times.schema[key].dataType.simpleString()
    own = times.select(F.col(key).alias("key"), F.col(at).cast("double").alias("at"))
    own = stored(own.where(F.col("at").isNotNull() & ~F.isnan("at") & (F.abs("at") < float("inf"))).distinct())
    both = own.withColumn("own", F.lit(True)).union(own.select("key", F.col("at") + F.lit(float(gap)), F.lit(False)))
    order = [F.desc("key"), F.desc("at"), F.desc("own")]
    struct = _parse_datatype_string(f"key {kind}, at double, own boolean, part int, n long, ahead long, same boolean")
    schema = to_arrow_schema(struct)
    # a probe comes behind the times it reaches: falling order, times first
    sorted_ = both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = stored(sorted_.mapInArrow(lambda batches: _counted(batches, schema), struct))
    per = placed.groupBy("part").agg(F.count_if("own").alias("times"), F.count_if(~F.col("own")).alias("probes"), F.max_by(F.struct("key"), F.when(F.col("own"), F.col("n"))).alias("last"))
    offsets, times_before, probes_before, last = [], 0, 0, None
    for r in sorted(per.collect(), key=lambda r: r.part):
        offsets.append((r.part, times_before, probes_before, last is not None, last.key if last is not None else None))
        times_before, probes_before, last = times_before + r.times, probes_before + r.probes, r.last if r.times else last
    moved = F.broadcast(own.sparkSession.createDataFrame(offsets, f"part int, times long, probes long, some boolean, carried {kind}"))
    all_ = placed.join(moved, "part")
    nodes = all_.where("own").select((F.col("n") + F.col("times")).alias("node"), "key", "at")
    reaches = F.coalesce("same", F.col("some") & F.col("key").eqNullSafe(F.col("carried")))
    edges = all_.where("not own").select((F.col("n") + F.col("probes")).alias("node"), F.when(reaches, F.col("ahead") + F.col("times")).alias("next"))
    # the i-th probe of the sort is that of the i-th time, as moving on keeps the order
    return stored(nodes.join(edges, "node"))


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node) of all that ``starts`` (node) reach by ``edges`` (node, next), themselves too."""
    jump = edges.where("next is not null")
    for _ in range(_PRUNE):
        # only what something points to, or what starts, can be on the way
        useful = jump.select(F.col("next").alias("node")).union(starts).distinct()
        jump = stored(jump.join(useful, "node", "left_semi"))
    found = stored(starts.distinct())
    while not jump.isEmpty():
        found = stored(found.union(found.join(jump, "node").select(F.col("next").alias("node"))).distinct())
        far = jump.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        jump = stored(jump.join(far, "next").select("node", F.col("beyond").alias("next")))
    return found


def thinned(times: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """(key, at) of each key's first time and of every one at least ``gap`` behind
    the last one kept; ``gap`` is above 0. Equal times are one, times that are null or
    not finite are left out, a null key is a key."""
    if not gap > 0:
        raise ValueError("a gap is above 0")
    nodes = successors(times, key, at, gap)
    starts = nodes.groupBy("key").agg(F.max("node").alias("node")).select("node")
    kept = reached(nodes.select("node", "next"), starts)
    return nodes.join(kept, "node", "left_semi").select(F.col("key").alias(key), F.col("at").alias(at))
