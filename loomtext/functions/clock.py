"""Times within media, formats of numbers, and small arithmetic, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _clock(seconds: Column, wide: bool) -> Column:
    """m:ss or, from an hour on, h:mm:ss, with ``wide`` the hours padded."""
    hours, minutes, rest = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    short = F.concat(minutes.cast("string"), F.lit(":"), _two(rest))
    return F.when(hours > 0, F.concat(_two(hours) if wide else hours.cast("string"), F.lit(":"), _two(minutes), F.lit(":"), _two(rest))).otherwise(short)


def format_ms(ms: Column) -> Column:
    """Milliseconds as m:ss or h:mm:ss, negative ones as 0:00."""
    return _clock(F.floor(F.greatest(F.round(ms), F.lit(0)) / 1000), False)


def format_seconds(seconds: Column) -> Column:
    """Seconds as m:ss or hh:mm:ss."""
    return _clock(F.floor(F.greatest(seconds, F.lit(0))), True)


def _number(text: Column) -> Column:
    plain = F.trim(text)
    return F.when(plain == "", 0.0).when(plain.rlike(r"^\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), plain.try_cast("double"))


def parse_clock_ms(text: Column) -> Column:
    """``seconds``, ``mm:ss`` or ``hh:mm:ss`` (comma or point) in milliseconds, else null."""
    plain = F.trim(text)
    parts = F.split(plain, ":")
    n = F.size(parts)
    at = lambda i: F.get(parts, n - i)
    total = F.coalesce(F.when(n == 3, _number(at(3))), F.when(n == 2, F.lit(0.0))) * 3600 + _number(at(2)) * 60 + _number(F.replace(at(1), F.lit(","), F.lit(".")))
    return F.when(plain.rlike(r"^\d+(\.\d+)?\z"), F.round(plain.try_cast("double") * 1000)).when(n.between(2, 3), F.round(total * 1000)).cast("long")


def parse_time_ms(text: Column, seconds: bool = False) -> Column:
    """A clock time, or a number of milliseconds (of seconds with ``seconds``)."""
    plain = F.trim(text)
    number = F.round(F.when(plain != "", _number(plain)) * (1000 if seconds else 1)).cast("long")
    return F.coalesce(F.when(F.contains(plain, F.lit(":")), parse_clock_ms(plain)), number)


def parse_seconds(text: Column) -> Column:
    """``mm:ss`` or ``hh:mm:ss`` in whole seconds, else null."""
    ok = F.trim(text).rlike(r"^\d+(:\d+){1,2}\z")
    parts = F.split(F.trim(text), ":")
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("double"), lambda a, p: a * 60 + p.try_cast("double")))


def timed_text(segments: Column) -> Column:
    """``[m:ss] text`` lines of segments (startMs, text), blank texts left out; null if none."""
    lines = F.transform(segments, lambda s: F.struct(s["startMs"].alias("at"), F.trim(F.regexp_replace(s["text"], r"\s+", " ")).alias("text")))
    lines = F.filter(lines, lambda s: s["text"] != "")
    return F.nullif(F.array_join(F.transform(lines, lambda s: F.concat(F.lit("["), format_ms(s["at"]), F.lit("] "), s["text"])), "\n"), F.lit(""))


def parse_timed_text(text: Column) -> Column:
    """array(at seconds, text) of ``[m:ss] text`` lines, by time and then place."""
    pattern = r"^\[(\d{1,2}:\d{2}(?::\d{2})?)\]\s*(.+)\z"
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("pos"))), lambda x: x["line"].rlike(pattern))
    rows = F.transform(lines, lambda x: F.struct(parse_seconds(F.regexp_extract(x["line"], pattern, 1)).alias("at"), x["pos"].alias("pos"), F.trim(F.regexp_extract(x["line"], pattern, 2)).alias("text")))
    return F.transform(F.array_sort(rows), lambda x: F.struct(x["at"].alias("at"), x["text"].alias("text")))


def clamp(value: Column, low, high) -> Column:
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def round_threshold(value: Column) -> Column:
    return F.round(value, 2)


def elapsed(ms: Column) -> Column:
    """1.2s, 12s, 3m 4s, 1h 2m 3s; ``unknown`` below zero."""
    total = F.floor(ms / 1000)
    text = lambda n: n.cast("long").cast("string")
    minutes = F.concat(text(F.floor(total % 3600 / 60)), F.lit("m "), text(total % 60), F.lit("s"))
    out = F.when(ms < 0, "unknown").when(total < 10, F.concat(F.format_string("%.1f", ms / 1000), F.lit("s"))).when(total < 60, F.concat(text(total), F.lit("s")))
    return out.when(total < 3600, minutes).otherwise(F.concat(text(F.floor(total / 3600)), F.lit("h "), minutes))


def byte_size(n: Column) -> Column:
    """1023 B, 1.5 KB, 12 MB: one decimal under ten."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        v = n / 1024.0**k
        out = F.when(v >= 1, F.concat(F.when(v < 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.0f", v)), F.lit(f" {unit}"))).otherwise(out)
    return out


def byte_rate(n: Column) -> Column:
    return F.concat(byte_size(n), F.lit("/s"))


def byte_label(n: Column) -> Column:
    """12B, 1.5KB up to GB, one decimal, no blank."""
    out = F.concat(n.cast("long").cast("string"), F.lit("B"))
    for k, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", n / 1024.0**k), F.lit(unit))).otherwise(out)
    return out


def compact_count(n: Column) -> Column:
    """999, 1.2k, 12k, 3.4M: one decimal under ten."""
    def short(v, unit):
        return F.concat(F.when(v < 10, F.regexp_replace(F.format_string("%.1f", v), r"\.0$", "")).otherwise(F.format_string("%.0f", v)), F.lit(unit))

    return F.when(n < 1000, F.round(n).cast("long").cast("string")).when(n < 1e6, short(n / 1e3, "k")).when(n < 1e9, short(n / 1e6, "M")).otherwise(short(n / 1e9, "B"))


def usd(cost: Column) -> Column:
    """Dollars with four decimals, two from ten cents on."""
    return F.when(cost < 0.1, F.concat(F.lit("$"), F.format_string("%.4f", cost))).otherwise(F.concat(F.lit("$"), F.format_string("%.2f", cost)))


def words_from_chars(n: Column) -> Column:
    return F.round(n / 6).cast("long")


def minutes_from_words(n: Column) -> Column:
    return F.greatest(F.ceil(n / 160), F.lit(1)).cast("long")


def upper_bound(last_said: Column, duration: Column) -> Column:
    """The later of the last time in a transcript and a medium's whole seconds; a
    duration that is null, not finite or not above 0 counts as unknown."""
    known = F.when((duration > 0) & (duration < float("inf")) & ~F.isnan(duration), F.floor(duration).cast("double"))
    return F.greatest(last_said.cast("double"), known)


def completion_tokens(n_chars: Column) -> Column:
    return F.greatest(F.lit(256), F.ceil(n_chars / 4)).cast("long")


def retry_delay_ms(attempt: Column, jitter: Column) -> Column:
    return F.least(F.lit(2000), 500 * (attempt + 1) + jitter)


def average_hash(pixels: Column) -> Column:
    """1 for each value at or over the mean, else 0."""
    total = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.transform(pixels, lambda x: F.when(x.cast("double") >= total / F.size(pixels), 1).otherwise(0))


def hash_distance(a: Column, b: Column) -> Column:
    """Share of places that differ, over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    unlike = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(unlike, F.lit(0), lambda s, x: s + x) / n)


def frame_quality(brightness: Column, contrast: Column) -> Column:
    """Mean of how far brightness is from either end and contrast as share of 64."""
    return (1 - F.abs(brightness - 128) / 128) * 0.5 + F.least(contrast / 64, F.lit(1.0)) * 0.5


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, clamp(F.floor(done / total * 100), 0, 100))
