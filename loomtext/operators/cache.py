"""The result cache as a table (kind, key, value, size_bytes, created_at,
last_accessed_at, expires_at), and what reads and writes do to it.

``now`` is always a parameter. An operation returns the table's next state; at
scale that is a rewrite of the partitions concerned or a MERGE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ["kind", "key"]
POSITIVE_TTL_MS, NEGATIVE_TTL_MS = 7 * 86_400_000, 6 * 3_600_000


def is_expired(now: int) -> Column:
    return F.col("expires_at").isNotNull() & (F.col("expires_at") <= now)


def read(cache: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """``wanted`` (kind, key) with value and status hit, expired or miss."""
    found = wanted.join(cache.withColumn("found_", F.lit(True)), KEY, "left")
    status = F.when(F.col("found_").isNull(), "miss").when(is_expired(now), "expired").otherwise("hit")
    return found.select(*KEY, "value", status.alias("status"))


def touched(cache: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """After reads: entries read are accessed now, those found expired are gone."""
    keys = wanted.select(*KEY).distinct().withColumn("read_", F.lit(True))
    rows = cache.join(keys, KEY, "left").where(~(F.coalesce("read_", F.lit(False)) & is_expired(now)))
    return rows.withColumn("last_accessed_at", F.when(F.col("read_"), now).otherwise(F.col("last_accessed_at"))).select(cache.columns)


def within_size(cache: DataFrame, most: int, buckets: int = 64, sortable: int = 100_000) -> DataFrame:
    """The most recently used entries whose sizes together are within ``most``; 0
    or less sets no limit. Entries never accessed go first.

    Sizes are first summed by buckets of access time: whole buckets are kept or
    dropped, and the one in which the limit falls is split again until it has no
    more than ``sortable`` entries or is one instant. Only that one is sorted."""
    if most <= 0:
        return cache
    at, rows = F.col("last_accessed_at"), cache.select("last_accessed_at", "size_bytes")
    low, high = rows.agg(F.min("last_accessed_at"), F.max("last_accessed_at")).first()
    if low is None:
        return cache
    held, entries, width = 0, sortable + 1, 2
    while entries > sortable and width > 1:
        width = max(1, -(-(high - low + 1) // buckets))
        sums = rows.where(at.between(low, high)).groupBy(F.floor((at - low) / width).alias("b")).agg(F.sum("size_bytes").alias("n"), F.count("*").alias("m"))
        for r in sorted(sums.collect(), key=lambda r: -r["b"]):
            if held + (r["n"] or 0) > most:
                low, entries = low + r["b"] * width, r["m"]
                high = min(high, low + width - 1)
                break
            held += r["n"] or 0
        else:
            return cache.where(at >= low)
    newest = Window.partitionBy(F.lit(0)).orderBy(F.desc("last_accessed_at"), *KEY).rowsBetween(Window.unboundedPreceding, 0)
    part = cache.where(at.between(low, high)).withColumn("held_", F.coalesce(F.sum("size_bytes").over(newest), F.lit(0))).where(F.col("held_") + held <= most)
    return cache.where(at > high).union(part.drop("held_"))


def written(cache: DataFrame, entries: DataFrame, now: int, most: int = 0) -> DataFrame:
    """After writes of ``entries`` (kind, key, value, size_bytes, ttl_ms): expired
    entries are swept, equal keys replaced, the size is kept."""
    new = entries.select(*KEY, "value", "size_bytes", F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("last_accessed_at"), (now + F.col("ttl_ms")).cast("long").alias("expires_at"))
    kept = cache.where(~is_expired(now)).join(new.select(*KEY), KEY, "left_anti").select(new.columns)
    return within_size(kept.unionByName(new), most)


def stats(cache: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row: entries of each kind, in all, and bytes."""
    return cache.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.count("*").alias("total"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def transcript_read(mode: Column, found: Column, expired: Column, timed: Column, wants_times: Column) -> Column:
    """Status of a transcript read; a hit without times does not do where times are wanted."""
    out = F.when(mode == "bypass", "bypassed").when(~found, "miss").when(expired, "expired")
    return out.when(wants_times & ~timed, "miss").otherwise("hit")


def transcript_ttl(has_text: Column) -> Column:
    return F.when(has_text, POSITIVE_TTL_MS).otherwise(NEGATIVE_TTL_MS)


def transcript_writes(results: DataFrame) -> DataFrame:
    """What is worth writing: not transient, cacheable, with its time to live."""
    return results.where(~F.coalesce("transient", F.lit(False)) & F.coalesce("cacheable", F.lit(True))).withColumn("ttl_ms", transcript_ttl(F.coalesce(F.length("value") > 0, F.lit(False))))


def with_stale_fallback(fresh: DataFrame, cache: DataFrame) -> DataFrame:
    """Fresh results (kind, key, value, status), with an old entry's value where there is none."""
    old = cache.select(*KEY, F.col("value").alias("old_"))
    rows = fresh.join(old, KEY, "left")
    use = F.col("value").isNull() & F.col("old_").isNotNull()
    return rows.select(*KEY, F.coalesce("value", "old_").alias("value"), F.when(use, "fallback").otherwise(F.col("status")).alias("status"))


def first_cached(requests: DataFrame, candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """For requests (id, selection_key) the value under the selection key, else
    under the first of the ``candidates`` (id, pos, key) that has one."""
    values = cache.select("key", "value")
    direct = requests.join(values.withColumnRenamed("key", "selection_key").withColumnRenamed("value", "direct"), "selection_key", "left")
    hits = candidates.join(values, "key").groupBy("id").agg(F.min_by("value", "pos").alias("other"), F.min("pos").alias("pos"))
    return direct.join(hits, "id", "left").select("id", F.coalesce("direct", "other").alias("value"), F.when(F.col("direct").isNull(), F.col("pos")).alias("pos"))


def misses(requests: DataFrame, cache: DataFrame, now: int) -> DataFrame:
    """Requests that have to be computed: no live entry under their key."""
    return requests.join(cache.where(~is_expired(now)).select(*KEY), KEY, "left_anti")
