"""The cache of downloaded media as tables, and lookups in podcast directories.

The index (url, size_bytes, sha256, created_at, last_accessed_at, expires_at)
says what was stored, ``files`` (url, size_bytes, sha256) what lies in storage
now. Moving and deleting files is up to the caller, who finds out here which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtext.functions.payloads import loose_title
from loomtext.operators import cache as C

INDEX = ["url", "size_bytes", "sha256", "created_at", "last_accessed_at", "expires_at"]


def _cacheable() -> Column:
    return F.coalesce(F.col("url").rlike("(?i)^https?://"), F.lit(False))


def read(index: DataFrame, files: DataFrame, wanted: DataFrame, now: int, verify: str = "size") -> DataFrame:
    """``wanted`` (url) with status: hit, or why not: unfit, miss, expired, gone
    (no file), changed (a file of another size, or with ``verify`` hash of another
    sum), and the size and sum then known. A size or sum that the index does not
    know is not held against a file; ``hash`` learns the sum."""
    own = index.select("url", F.col("size_bytes").alias("size_"), F.col("sha256").alias("sum_"), "expires_at", F.lit(True).alias("known_"))
    seen = files.select("url", F.col("size_bytes").alias("now_size_"), F.col("sha256").alias("now_sum_"), F.lit(True).alias("there_"))
    rows = wanted.select("url").join(own, "url", "left").join(seen, "url", "left")
    differs = {"size": F.col("size_") != F.col("now_size_"), "hash": F.col("sum_") != F.col("now_sum_"), "none": F.lit(False)}[verify]
    status = F.when(~_cacheable(), "unfit").when(F.col("known_").isNull(), "miss").when(C.is_expired(now), "expired").when(F.col("there_").isNull(), "gone").when(F.coalesce(differs, F.lit(False)), "changed").otherwise("hit")
    learned = F.coalesce("sum_", "now_sum_") if verify == "hash" else F.col("sum_")
    return rows.select("url", status.alias("status"), F.coalesce("now_size_", "size_").alias("size_bytes"), learned.alias("sha256"))


def after_read(index: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """The index after ``read``: hits accessed now and of the size and sum found, expired, gone and changed entries out."""
    seen = found.groupBy("url").agg(F.max("status").alias("status_"), F.max("size_bytes").alias("size_"), F.max("sha256").alias("sum_"))
    rows = index.where(~C.is_expired(now)).join(seen, "url", "left").where(F.coalesce(~F.col("status_").isin("gone", "changed"), F.lit(True)))
    hit = F.coalesce(F.col("status_") == "hit", F.lit(False))
    return rows.withColumns({"size_bytes": F.when(hit, F.col("size_")).otherwise(F.col("size_bytes")), "last_accessed_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("last_accessed_at")), "sha256": F.when(hit, F.coalesce("sha256", "sum_")).otherwise(F.col("sha256"))}).select(INDEX)


def written(index: DataFrame, files: DataFrame, now: int, most: int = 0, ttl_ms: int = 0) -> DataFrame:
    """The index after ``files`` were put: expired entries out, equal URLs replaced,
    files that alone are over ``most`` not taken, the least recently used out until the rest fits."""
    fits = F.col("size_bytes") <= most if most > 0 else F.lit(True)
    end = F.lit(now + ttl_ms if ttl_ms > 0 else None).cast("long")
    new = files.where(_cacheable() & fits).select("url", "size_bytes", "sha256", F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("last_accessed_at"), end.alias("expires_at"))
    kept = index.where(~C.is_expired(now)).join(new.select("url"), "url", "left_anti").select(INDEX)
    rows = kept.unionByName(new).withColumns({"kind": F.lit("media"), "key": F.col("url")})
    return C.within_size(rows, most).select(INDEX)


def stale_files(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files that the index does not know any more."""
    return files.join(index.select("url"), "url", "left_anti")


def slide_files(payload: Column) -> Column:
    """Paths to remove with a slide record (JSON with slidesDir and slides of
    imagePath): images below its directory, then the record; null without a directory."""
    get = lambda p: F.nullif(F.trim(F.get_json_object(payload, p)), F.lit(""))
    folder = F.regexp_replace(get("$.slidesDir"), r"(?<=.)/+\z", "")
    paths = F.from_json(F.get_json_object(payload, "$.slides"), "array<struct<imagePath:string>>")
    inside = F.filter(F.transform(paths, lambda s: F.trim(s["imagePath"])), lambda p: F.startswith(p, F.concat(folder, F.lit("/"))) & ~p.rlike(r"/\.\.(/|\z)"))
    return F.when(F.startswith(folder, F.lit("/")), F.concat(F.coalesce(inside, F.array().cast("array<string>")), F.array(F.concat(folder, F.lit("/slides.json")))))


def looked_up_episodes(wanted: DataFrame, episodes: DataFrame) -> DataFrame:
    """For ``wanted`` (show_id, episode_id) the episode of that track id, else the
    show's newest; undated ones come last, then the first listed."""
    rank = F.struct(F.coalesce(F.col("track_id") == F.col("episode_id"), F.lit(False)), F.col("released").isNotNull(), F.col("released"), -F.col("pos"))
    rows = wanted.join(episodes, "show_id").groupBy("show_id", "episode_id")
    return rows.agg(F.max_by("track_id", rank).alias("track_id"), F.max_by("url", rank).alias("url")).where(F.col("url").rlike("(?i)^https?://"))


def searched_episodes(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """For ``wanted`` (id, show, episode) the best of the search ``results`` (id, pos,
    title, collection, url): both titles equal, the episode's equal, else the first listed."""
    usable = results.where((F.trim("title") != "") & (F.trim("url") != ""))
    named = loose_title(F.col("title")) == loose_title(F.col("episode"))
    rank = F.struct(named & F.coalesce(loose_title(F.col("collection")) == loose_title(F.col("show")), F.lit(False)), named, -F.col("pos"))
    return wanted.join(usable, "id").groupBy("id").agg(F.max_by("url", rank).alias("url"), F.max_by("title", rank).alias("title"))


def show_feeds(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """(id, feed_url) for ``wanted`` (id, show): of a directory's ``results`` (id, pos,
    collection, feed_url) the first with the show's loose title, else the first, if its
    feed is an http(s) address."""
    rows = wanted.join(results, "id")
    rank = F.struct((loose_title(F.coalesce("collection", F.lit(""))) != loose_title(F.col("show"))).alias("other"), "pos")
    best = rows.groupBy("id").agg(F.min_by(F.trim("feed_url"), rank).alias("feed_url"))
    return best.where(F.col("feed_url").rlike("(?i)^https?://"))
