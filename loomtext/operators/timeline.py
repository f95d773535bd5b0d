"""Timelines within media: gaps, scenes, slides and their transcripts.

Folds over one medium's sorted array are Columns; what relates two tables of
many media is a join on the medium with a range or a bucketed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtext.functions import clock, text as T

SLIDE_TEXT_BUDGET = {"short": 120, "medium": 200, "long": 320, "xl": 480, "xxl": 700}
SLIDE_WINDOW_SECONDS = {"short": 30, "medium": 60, "long": 90, "xl": 120, "xxl": 180}


def finite_sorted(times: Column) -> Column:
    return F.array_sort(F.filter(times, lambda t: t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))))


def spaced(times: Column, gap: Column | float) -> Column:
    """Of times in order, each that is at least ``gap`` behind the last one kept."""
    none = F.array().cast("array<double>")
    far = lambda kept, t: (F.size(kept) == 0) | (t - F.element_at(kept, -1) >= gap)
    return F.aggregate(finite_sorted(times), none, lambda kept, t: F.when(far(kept, t), F.concat(kept, F.array(t.cast("double")))).otherwise(kept))


def min_duration(times: Column, least: float) -> Column:
    return times if least <= 0 else spaced(times, least)


def merged(scenes: Column, intervals: Column, least: float) -> Column:
    """Both lists in order, thinned to half the least duration, a tenth of a second at least."""
    return spaced(F.concat(scenes, intervals), max(0.1, least * 0.5))


def scene_segments(times: Column, duration: Column) -> Column:
    """array(start, end): 0 and the boundaries over 0.05 s apart; an end that does not follow its start is null."""
    good = F.filter(finite_sorted(times), lambda t: t >= 0)
    none = F.array().cast("array<double>")
    far = lambda kept, t: (F.size(kept) == 0) | (t - F.element_at(kept, -1) > 0.05)
    marks = F.aggregate(good, none, lambda kept, t: F.when(far(kept, t), F.concat(kept, F.array(t.cast("double")))).otherwise(kept))
    pairs = F.arrays_zip(F.concat(F.array(F.lit(0.0)), marks).alias("start"), F.concat(marks, F.array(duration.cast("double"))).alias("end"))
    return F.transform(pairs, lambda p: F.struct(p["start"].alias("start"), F.when(p["end"] > p["start"], p["end"]).alias("end")))


def segment_at(segments: Column, at: Column) -> Column:
    """The first segment that holds a time, else the last."""
    hit = F.filter(segments, lambda s: (at >= s["start"]) & (s["end"].isNull() | (at < s["end"])))
    return F.coalesce(F.get(hit, F.lit(0)), F.try_element_at(segments, F.lit(-1)))


def adjusted(at: Column, start: Column, end: Column) -> Column:
    """A time moved inside its segment by a padding of 8 % of it, 0.2 to 1.5 s."""
    low = F.greatest(start, F.lit(0.0))
    length = end - low
    pad = F.least(F.lit(1.5), F.greatest(F.lit(0.2), length * 0.08))
    inside = F.when(length <= pad * 2, low + length * 0.5).otherwise(clock.clamp(at, low + pad, end - pad))
    return F.when(start.isNull(), at).when(end.isNull() | (end <= low), F.greatest(at, low)).otherwise(inside)


def extracted_time(requested: Column, actual: Column, base: Column) -> Column:
    """What time a frame really has: absolute or relative to where was sought, whichever is nearer."""
    relative = base + actual
    near = F.when(F.abs(relative - requested) <= F.abs(actual - requested), relative).otherwise(actual)
    plain = F.when(actual <= 5, requested + actual).otherwise(actual)
    return F.when(actual.isNull() | (actual < 0), requested).when(base > 0, near).otherwise(plain)


def target_times(targets: Column, scenes: Column, least: float, interval: Column | float) -> Column:
    """For each target the nearest scene within the window, or the target itself
    if there is none or it is too near the one picked before."""
    window = F.greatest(F.lit(2.0), F.least(F.lit(10.0), (interval if isinstance(interval, Column) else F.lit(interval)) * 0.35))
    marks = spaced(scenes, max(0.1, least * 0.25))

    def step(picked, target):
        near = F.filter(marks, lambda m: F.abs(m - target) <= window)
        best = F.array_min(F.transform(near, lambda m: F.struct(F.abs(m - target).alias("gap"), m.alias("at"))))["at"]
        choice = F.coalesce(best, target)
        ok = (F.size(picked) == 0) | (choice - F.element_at(picked, -1) >= least)
        return F.concat(picked, F.array(F.when(ok, choice).otherwise(target).cast("double")))

    return F.aggregate(finite_sorted(targets), F.array().cast("array<double>"), step)


def interval_times(duration: Column, least: float, most: int) -> Column:
    """struct(interval, times): steps through a medium, 6 to 20 of them by length, ``most`` at most."""
    count = F.least(F.lit(max(1, most)), clock.clamp(F.round(duration / 180), 6, 20))
    interval = F.greatest(F.lit(float(least)), duration / count)
    n = F.ceil(duration / interval).cast("int")
    times = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i * interval)
    return F.when(duration > 0, F.struct(interval.alias("interval"), F.filter(times, lambda t: t < duration).alias("times")))


def slide_plan(media: DataFrame, key: str, least: float, most: int) -> DataFrame:
    """(key, index, at, start, end) of the slides to take of ``media`` (key, duration,
    scenes): at even steps, moved to the nearest scene, or at the scenes themselves
    where the duration is not known; at least ``least`` apart, each moved inside its
    scene's segment, ``most`` at most. A medium's scenes are one array; for times that
    do not fit into one see ``operators.thinning``."""
    scenes = F.coalesce("scenes", F.array().cast("array<double>"))
    rows = media.withColumns({"i_": interval_times(F.col("duration"), least, most), "s_": scenes})
    steps = F.coalesce("i_.times", F.array().cast("array<double>"))
    chosen = F.when(F.size(steps) > 0, target_times(steps, F.col("s_"), least, F.col("i_.interval"))).otherwise(merged(F.col("s_"), steps, least))
    rows = rows.select(key, scene_segments(F.col("s_"), F.col("duration")).alias("g_"), min_duration(chosen, least).alias("t_"))
    rows = rows.select(key, "g_", F.posexplode(F.slice("t_", 1, most) if most > 0 else F.col("t_")).alias("pos", "t_"))
    rows = rows.select(key, (F.col("pos") + 1).alias("index"), "t_", segment_at(F.col("g_"), F.col("t_")).alias("s_"))
    return rows.select(key, "index", adjusted(F.col("t_"), F.col("s_.start"), F.col("s_.end")).alias("at"), F.col("s_.start").alias("start"), F.col("s_.end").alias("end"))


def split_segments(duration: Column, workers: int) -> Column:
    """array(start, duration): about a minute each, at most ``workers`` (16)."""
    workers = max(1, min(16, workers))
    n = F.least(F.lit(workers), F.ceil(duration / 60)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * duration / n).alias("start"), (duration / n).alias("duration")))
    whole = F.array(F.struct(F.lit(0.0).alias("start"), F.coalesce(duration, F.lit(0.0)).alias("duration")))
    return F.when((duration > 0) & F.lit(workers > 1), parts).otherwise(whole)


def calibration_times(duration: Column, samples: int) -> Column:
    """Sample times between 5 % and 95 % of a medium, 3 to 12."""
    n = max(3, min(12, samples))
    times = F.array(*(clock.clamp(duration * (0.05 + 0.9 / (n - 1) * i), 0.0, duration - 0.1) for i in range(n)))
    return F.when(duration > 0, times).otherwise(F.array(F.lit(0.0)))


def nearest_rank(values: Column, share: float) -> Column:
    """Of sorted values the one at round((n - 1) * share)."""
    return F.get(values, F.round((F.size(values) - 1) * share).cast("int"))


def diff_stats(values: Column) -> Column:
    """struct(median, p75, p90, max) by nearest rank, zeros if there are none."""
    v = F.sort_array(values)
    pick = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(pick(nearest_rank(v, 0.5)).alias("median"), pick(nearest_rank(v, 0.75)).alias("p75"), pick(nearest_rank(v, 0.9)).alias("p90"), pick(F.try_element_at(v, F.lit(-1))).alias("max"))


def scene_threshold(stats: Column, count: Column) -> Column:
    """struct(threshold, confidence) from the statistics of ``count`` differences."""
    low = clock.round_threshold(F.greatest(stats["median"] * 0.15, stats["p75"] * 0.2, stats["p90"] * 0.25))
    low = F.when(stats["p75"] >= 0.12, F.least(low, F.lit(0.05))).when(stats["p90"] < 0.05, 0.05).otherwise(low)
    sure = F.when(count >= 2, stats["p75"]).otherwise(stats["max"]) / 0.25
    return F.struct(clock.clamp(low, 0.05, 0.3).alias("threshold"), clock.clamp(sure, 0.0, 1.0).alias("confidence"))


def numbered(rows: DataFrame, by: str, order: str, most: int | None = None) -> DataFrame:
    """Rows of each medium numbered from 1 in order, the first ``most`` of them."""
    out = rows.withColumn("index", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    return out if most is None or most <= 0 else out.where(F.col("index") <= most)


def neighbours(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Rows with the time before and behind within their medium."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumns({"before": F.lag(order).over(w), "behind": F.lead(order).over(w)})


def slide_window_seconds(preset: str | None, chars: int | None = None) -> int:
    """By preset, or by the number of characters asked for."""
    if preset:
        return SLIDE_WINDOW_SECONDS[preset]
    return int(min(180, max(30, round(chars / 50))))


def slide_text_budget(preset: str | None, slides: int, chars: int | None = None) -> int:
    if preset:
        return SLIDE_TEXT_BUDGET[preset]
    return int(min(900, max(80, round(chars / max(1, slides)))))


def slide_texts(slides: DataFrame, segments: DataFrame, by: str, window: int, budget: int) -> DataFrame:
    """(by, index, text): for each slide (by, index, at) the segments (by, start,
    pos, text) from a short lead-in to the next slide, ``window`` seconds at most.

    A range join: segments meet a slide under the time buckets its window covers,
    so the work follows the windows, not slides times segments."""
    w = Window.partitionBy(by).orderBy("at", "index")
    lead = min(6, int(window * 0.2))
    rows = slides.withColumn("next", F.floor(F.lead("at").over(w))).withColumn("from", F.floor(F.greatest("at", F.lit(0.0))))
    rows = rows.withColumns({"lower": F.greatest(F.col("from") - lead, F.lit(0)), "upper": F.when(F.col("next") > F.col("from"), F.least(F.col("from") + window, F.col("next"))).otherwise(F.col("from") + window)})
    bucket = lambda c: F.floor(c / window).cast("long")
    rows = rows.withColumn("bucket", F.explode(F.sequence(bucket(F.col("lower")), bucket(F.col("upper")))))
    found = rows.join(segments.select(by, F.col("start"), "pos", F.col("text"), bucket(F.col("start")).alias("bucket")), [by, "bucket"], "left").where(F.col("start").isNull() | F.col("start").between(F.col("lower"), F.col("upper")))
    parts = found.groupBy(by, "index").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("start", "pos", "text")))).alias("parts"))
    joined = T.normalize_candidate(F.array_join(F.col("parts.text"), " "))
    texts = parts.select(by, "index", F.coalesce(T.truncate_words(joined, budget), F.lit("")).alias("text"))
    return slides.select(by, "index").join(texts, [by, "index"], "left").select(by, "index", F.coalesce("text", F.lit("")).alias("text"))


def slide_prompt(slides: Column, segments: Column, total: int) -> Column:
    """Blocks for slides (index, at) in order: a label with the span halfway to
    the neighbours and 10 s more (30 s at the ends), and what is said in it, each
    within its share of ``total`` characters and what the blocks before left."""
    order = F.array_sort(F.transform(slides, lambda s: F.struct(F.floor(F.greatest(s["at"], F.lit(0.0))).alias("at"), s["index"].alias("index"))))
    n = F.size(order)
    share = F.greatest(F.lit(120), F.floor(total / n))

    def step(state, i):
        at, before, behind = F.get(order, i)["at"], F.get(order, i - 1)["at"], F.get(order, i + 1)["at"]
        start = F.greatest(F.lit(0), F.when(i > 0, F.floor((before + at) / 2)).otherwise(at - 30) - 10)
        end = F.when(i < n - 1, F.ceil((at + behind) / 2)).otherwise(at + 30) + 10
        said = F.array_join(F.transform(F.filter(segments, lambda s: s["at"].between(start, end)), lambda s: s["text"]), " ")
        room = F.least(share, state["left"]).cast("int")
        cut = F.when(room > 0, F.coalesce(T.truncate_words(T.normalize_candidate(said), room, "…"), F.lit(""))).otherwise("")
        label = F.concat(F.lit("[slide:"), F.get(order, i)["index"].cast("string"), F.lit("] ["), clock.format_seconds(start), F.lit("–"), clock.format_seconds(end), F.lit("]"))
        block = F.when(cut == "", label).otherwise(F.concat(label, F.lit("\n"), cut))
        return F.struct(F.concat(state["blocks"], F.array(block)).alias("blocks"), F.greatest(F.lit(0), state["left"] - F.length(block)).cast("int").alias("left"))

    start = F.struct(F.array().cast("array<string>").alias("blocks"), F.lit(total).alias("left"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: F.array_join(s["blocks"], "\n\n")))


def interleaved(timed: Column, slides: Column) -> Column:
    """Timed text with a marker line for each slide (index, at) before the first
    line at or behind it; slides behind the last line follow it."""
    order = F.array_sort(F.transform(F.filter(slides, lambda s: s["at"].isNotNull()), lambda s: F.struct(s["at"].cast("double").alias("at"), s["index"].alias("index"))))

    def step(state, line):
        at = clock.parse_seconds(F.regexp_extract(F.trim(line), r"^\[(\d{1,2}:\d{2}(?::\d{2})?)\]", 1))
        due = F.filter(F.slice(order, state["next"] + 1, F.size(order)), lambda s: s["at"] <= at)
        marks = F.transform(due, lambda s: F.concat(F.lit("[slide:"), s["index"].cast("string"), F.lit("]")))
        return F.struct(F.concat(state["out"], marks, F.array(line)).alias("out"), (state["next"] + F.size(due)).alias("next"))

    rest = lambda s: F.transform(F.slice(order, s["next"] + 1, F.size(order)), lambda x: F.concat(F.lit("[slide:"), x["index"].cast("string"), F.lit("]")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("next"))
    done = F.aggregate(F.split(timed, "\n"), start, step, lambda s: F.array_join(F.concat(s["out"], rest(s)), "\n"))
    return F.when((F.trim(timed) == "") | (F.size(order) == 0), timed).otherwise(done)


def last_time(segments: Column, timed: Column, duration: Column) -> Column:
    """Last whole second of segments (startMs, endMs), timed lines and the duration; null if all lack it."""
    ends = F.transform(segments, lambda s: F.floor(F.greatest(s["startMs"], s["endMs"]) / 1000))
    lines = F.transform(clock.parse_timed_text(timed), lambda s: F.floor(s["at"]))
    return F.greatest(F.array_max(ends), F.array_max(lines), F.when(duration > 0, F.floor(duration)))


def even_split(items: Column, n: int) -> Column:
    """``n`` slices of an array, cut at round(i * size / n)."""
    cut = lambda i: F.round(i * F.size(items) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(items, cut(i) + 1, F.greatest(cut(i + 1) - cut(i), F.lit(0))))


def ring(rows: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """Of each key the newest rows whose sizes together are within ``most``."""
    newest = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("held_", F.sum(size).over(newest)).where(F.col("held_") <= most).drop("held_")


def monotone_progress(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows that raise the running maximum, with it."""
    w = Window.partitionBy(by).orderBy(order)
    out = rows.withColumn("top", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("before_", F.lag("top").over(w)).where(F.col("before_").isNull() | (F.col("top") > F.col("before_"))).drop("before_")


def asof_segments(points: DataFrame, starts: DataFrame, by: str) -> DataFrame:
    """Each point (by, at) with the last start (by, start) at or before it.

    One union and one window: a running maximum carries the start forward, so
    there is no range join."""
    rows = points.select(by, "at", F.lit(1).alias("kind_"), F.lit(None).cast("double").alias("start_"))
    rows = rows.union(starts.select(by, F.col("start").alias("at"), F.lit(0).alias("kind_"), F.col("start").cast("double").alias("start_")))
    w = Window.partitionBy(by).orderBy("at", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("start", F.max("start_").over(w)).where("kind_ = 1").drop("kind_", "start_")
