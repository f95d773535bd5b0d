import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import thinning as N, timeline as L
from loomtext.plans import catalog, transcripts


def brute(rows, gap):
    out = set()
    for k in {r[0] for r in rows}:
        last = None
        for t in sorted({r[1] for r in rows if r[0] == k and r[1] is not None and r[1] == r[1] and abs(r[1]) < 1e300}):
            if last is None or t >= last + gap:
                out.add((k, t))
                last = t
    return out


@pytest.mark.parametrize("partitions, gap", [(1, 7.0), (6, 7.0), (6, 0.5), (3, 5000.0)])
def test_thinned_equals_a_fold(spark, partitions, gap):
    rnd = random.Random(partitions)
    rows = [(rnd.choice(["a", "a", "a", "b", None, "c"]), rnd.choice([float(rnd.randint(0, 300)), rnd.random() * 1000, -rnd.random()])) for _ in range(900)] + [("z", 5.0), ("z", None), ("y", float("nan")), ("x", float("inf"))]
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = own.createDataFrame(rows, "k string, t double").repartition(partitions)
    assert {tuple(r) for r in N.thinned(df, "k", "t", gap).collect()} == brute(rows, gap)


def test_thinned_without_rows_and_with_a_wrong_gap(spark):
    df = spark.createDataFrame([("a", 1)], "k string, t int")
    assert N.thinned(df.limit(0), "k", "t", 1.0).count() == 0 and N.thinned(df, "k", "t", 1.0).collect() == [("a", 1.0)]
    with pytest.raises(ValueError):
        N.thinned(df, "k", "t", 0.0)


def plan(duration, scenes, least, most):
    """Slides of one medium, step by step."""
    def thin(times, gap):
        out = []
        for t in sorted(times):
            if not out or t - out[-1] >= gap:
                out.append(t)
        return out

    marks = [t for t in scenes if t >= 0]
    bounds = []
    for t in sorted(marks):
        if not bounds or t - bounds[-1] > 0.05:
            bounds.append(t)
    segments = [(a, b if b is not None and b > a else None) for a, b in zip([0.0, *bounds], [*bounds, duration])]
    if duration and duration > 0:
        count = min(max(1, most), max(6, min(20, int(duration / 180 + 0.5))))
        step = max(least, duration / count)
        targets, i = [], 0
        while i * step < duration:
            targets.append(i * step)
            i += 1
        window, near, chosen = max(2.0, min(10.0, step * 0.35)), thin(scenes, max(0.1, least * 0.25)), []
        for t in targets:
            best = min((m for m in near if abs(m - t) <= window), key=lambda m: (abs(m - t), m), default=t)
            chosen.append(best if not chosen or best - chosen[-1] >= least else t)
    else:
        chosen = thin(scenes, max(0.1, least * 0.5))
    out = []
    for k, t in enumerate(thin(chosen, least)[:most]):
        a, b = next((s for s in segments if t >= s[0] and (s[1] is None or t < s[1])), segments[-1])
        low = max(a, 0.0)
        if b is None or b <= low:
            at = max(t, low)
        else:
            pad = min(1.5, max(0.2, (b - low) * 0.08))
            at = low + (b - low) * 0.5 if b - low <= 2 * pad else min(max(t, low + pad), b - pad)
        out.append((k + 1, round(at, 6), a, b))
    return out


def test_slide_plan_equals_steps_by_hand(spark, sf):
    media = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").where("event_type <> 'error'").select("user_id", F.datediff("ts", F.lit("2024-01-01")).alias("day"), "value").collect():
        m = media.setdefault(r.user_id, ([], []))
        m[0].append(r.day * 60 + r.value)
        m[1].append(r.day * 60.0 + 90)
    got = {}
    for r in catalog.QUERIES["slide_plan"](spark, sf).collect():
        got.setdefault(r.user_id, []).append((r["index"], round(r.at, 6), r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {k: plan(max(d) if k % 5 else None, sorted(s), 15.0, 40) for k, (s, d) in media.items()}


def test_slide_plan_of_odd_media(spark):
    rows = [("none", None, None), ("empty", 100.0, []), ("null scenes", 0.0, None), ("nan", -1.0, [float("nan"), None, 3.0, -2.0])]
    got = {}
    for r in L.slide_plan(spark.createDataFrame(rows, "m string, duration double, scenes array<double>"), "m", 5.0, 3).collect():
        got.setdefault(r.m, []).append((r["index"], round(r.at, 3)))
    assert set(got) == {"empty", "nan"} and [i for i, _ in got["empty"]] == [1, 2, 3]


def test_parts_are_joined_in_order_up_to_the_first_that_fails(spark):
    rows = spark.createDataFrame([(1, "abcdefg"), (2, "abcdefg"), (3, ""), (4, None), (None, "xy"), (5, "abc")], "id long, sound string")
    fails = lambda *at: lambda r: r.withColumns({"failure": F.when(F.concat("id", F.lit("."), "part").isin(*at), F.concat(F.lit("lost "), "part")), "value": F.when(~F.coalesce(F.concat("id", F.lit("."), "part").isin(*at), F.lit(False)), F.when(F.col("sound") != "c", F.upper("sound")))})
    out = transcripts.chunked(rows, "id", "sound", 2, [fails("1.1", "2.1", "2.3"), fails("2.1", "2.3")])
    got = {r.id: tuple(r)[1:] for r in out.collect()}
    assert got[1] == (4, 4, "AB\n\nCD\n\nEF\n\nG", None, "cut into 4 parts of 2")
    assert got[2] == (4, 1, None, "lost 1", "cut into 4 parts of 2") and got[3] == got[4] == (0, 0, None, "no parts", None)
    assert got[None] == (1, 1, "XY", None, "cut into 1 parts of 2") and got[5] == (2, 2, "AB", None, "cut into 2 parts of 2")
