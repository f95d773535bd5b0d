import random
import time

import pytest
from pyspark.sql import functions as F

from loomtext.functions import scan
from loomtext.functions.segments import Segmenter, joined
from loomtext.operators import media as D, streams as S
from loomtext.plans import catalog
from loomtext.streaming import clocks, stitch

PIECES = ["[", "]", "slide", "Slide ", "slide 3", " ", ":", "3", "12", "0", "\n", "\n\n", "of 10", "/", "·", "-", "Title:", "# Head", "word", "A sentence. ", "x" * 50, "y" * 170, " " * 45, "[slide:2]", "[slide]", "[note slide 7]", "slide:4]", "\t", "headline: Big", "é"]


def events(chunks, expected=()):
    """Neighbouring texts joined; the state goes through its saved form at every chunk."""
    own, out = Segmenter(), []
    for c in chunks:
        out += own.feed(c)
        own = Segmenter(own.state())
    return joined(out + own.finish(expected))


def cuts(text, rnd):
    at, out = 0, []
    while at < len(text):
        n = rnd.randint(0, 12)
        out.append(text[at : at + n])
        at += n
    return out


def test_slides_of_a_text():
    assert events(["Intro\n\n[slide:1]\nGraphene breakthroughs\nGraphene is strong."], [1, 2]) == [("text", None, "Intro\n\n"), ("slide", 1, "Graphene breakthroughs"), ("text", None, "Graphene is strong."), ("slide", 2, None)]
    assert events(["Intro\n\nslide:2]\nAfter it."]) == [("text", None, "Intro\n\n"), ("slide", 2, None), ("text", None, "After it.")]
    assert events(["Slide 3 of 10: gone\n# Head\nbody\n[see slide 4] Title:\n Real\nx"]) == [("slide", 3, "Head"), ("text", None, "body\n"), ("slide", 4, "Real"), ("text", None, "x")]
    assert events(["a [slide] b [Slide 0] c [x]"]) == [("text", None, "a  b  c [x]")]
    assert events(["[slide:1]A\nb[slide:1]C\nd"]) == [("slide", 1, "A"), ("text", None, "bd")]
    assert events(["[slide:1]" + "y" * 200 + "\nz"]) == [("slide", 1, None), ("text", None, "y" * 200 + "\nz")]
    assert events(["the slide 3\nslide 3x\n slide 3\n"]) == [("text", None, "the slide 3\nslide 3x\n"), ("slide", 3, None)]
    assert events([]) == events([""]) == events([None]) == [] and events([], [2]) == [("slide", 2, None)]


def test_no_cut_changes_the_slides():
    rnd = random.Random(3)
    for _ in range(4000):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 14)))
        whole = events([text], [1, 2])
        assert events(list(text), [1, 2]) == events(cuts(text, rnd), [1, 2]) == whole, text


def test_what_is_held_back_is_bounded():
    for text in ("[" + "a" * 10_000, "slide " + " " * 10_000, "slide 3: " + "b" * 10_000, "[slide:1]" + "c" * 10_000, "[slide 1" * 2000):
        own = Segmenter()
        for c in text:
            own.feed(c)
            assert len(own.tail) <= 500 and len(own.pending) <= 500


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_every_size_of_chunk_gives_the_same_parts(spark, sf, size):
    talks = spark.read.parquet(f"{sf}/conversations.parquet")
    parts = lambda n: rows_of(S.slide_parts(S.slide_events(catalog.slide_chunks(talks, n), "conv_id", ["turn", "i"], "chunk", "expected"), "conv_id"))
    assert parts(size) == parts(100_000)


def test_folds_of_nulls_hot_keys_and_no_rows(spark):
    rows = [("hot", i, "ab" * (i + 1)) for i in range(3000)] + [(None, 0, "x"), (None, None, "y"), ("n", 0, None)]
    df = spark.createDataFrame(rows, "k string, at int, chunk string").repartition(7)
    got = {(r.k, r.at): (r.appended, r.total) for r in S.merged_chunks(df, "k", "at", "chunk").collect()}
    assert len(got) == 3003 and got[("hot", 2999)] == ("ab", 6000) and got[("n", 0)] == ("", 0)
    assert got[(None, None)] == ("y", 1) and got[(None, 0)] == ("x", 2)
    assert S.merged_chunks(df.limit(0), "k", "at", "chunk").count() == 0


def test_ends_of_ties_nulls_and_no_rows(spark):
    rows = [("a", 0, False), ("a", 5, True), ("a", 5, False), ("a", 5, True), ("a", 9, False), ("b", 3, None), ("b", 13, None), ("b", 14, True), ("c", 7, True), (None, 1, False), ("d", 0, False), ("d", 10, True), ("d", 50, True)]
    df = spark.createDataFrame(rows, "stream_id string, at long, done boolean")
    got = {r[0]: tuple(r)[1:] for r in S.stream_ends(df, 10, 20).collect()}
    assert got == {"a": ("done", 5, 25, 0, 3, 2, 0), "b": ("timed out", 13, 33, 3, 2, 1, 0), "c": ("done", 7, 27, 7, 1, 0, 0), None: ("timed out", 11, 31, 1, 1, 0, 0), "d": ("done", 10, 30, 0, 2, 0, 1)}
    assert S.stream_ends(df.limit(0), 10, 20).count() == 0


def streamed(spark, files, schema, plan, tmp_path, name):
    """What a streaming plan wrote, reading one file in each micro-batch."""
    for i, df in enumerate(files):
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i:03}")
    own = clocks.with_timers(spark.newSession())
    own.conf.set("spark.sql.shuffle.partitions", "2")
    source = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    plan(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_stream_ends_as_the_watermark_moves(spark, sf, tmp_path):
    timeout, ttl = 129_600_000, 90_000_000
    own = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("done")).cache()
    days = own.select(F.min("ts"), F.max("ts")).first()
    step = (days[1] - days[0]) / 5
    files = [own.where((F.col("ts") >= days[0] + step * i) & ((F.col("ts") < days[0] + step * (i + 1)) if i < 4 else F.lit(True))) for i in range(5)]
    files += [spark.createDataFrame([("clock", days[1] + step * k, False)], own.schema) for k in (3, 6)]
    out = streamed(spark, files, own.schema, lambda s: clocks.stream_ends(s, timeout, ttl, known_ms=400 * 86_400_000), tmp_path, "ends").where("stream_id <> 'clock'")
    want = S.stream_ends(own.select("stream_id", F.unix_millis("ts").alias("at"), "done"), timeout, ttl).collect()
    assert {(r.stream_id, r.event, r.at, r.started, r.chunks) for r in out.where("event <> 'expired'").collect()} == {(r.stream_id, r.status, r.ended, r.started, r.chunks) for r in want}
    assert {(r.stream_id, r.at, r.late) for r in out.where("event = 'expired'").collect()} == {(r.stream_id, r.expires, r.late) for r in want}
    assert {"done", "timed out"} == {r.status for r in want} and any(r.gone for r in want)


def test_slide_stream_equals_the_batch_fold(spark, tmp_path):
    rnd = random.Random(6)
    rows, seq = [], {}
    for k in range(12):
        text = "".join(rnd.choice(PIECES) for _ in range(40))
        seq[str(k)] = [*cuts(text, rnd), None]
    rows = [(k, i, c, i * 4 // len(v)) for k, v in seq.items() for i, c in enumerate(v)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, chunk string, file int")
    files = [df.where(F.col("file") == i).drop("file") for i in range(4)]
    out = streamed(spark, files, files[0].schema, lambda s: clocks.slide_stream(s, 4), tmp_path, "slides").collect()
    for k, v in seq.items():
        own = sorted((r.event, r.kind, r.slide, r.value) for r in out if r.stream_id == k)
        assert [e[0] for e in own] == list(range(len(own)))
        assert joined([e[1:] for e in own]) == events(v[:-1], range(1, 5))


def test_late_subscribers_equal_early_ones(spark, tmp_path):
    events = spark.createDataFrame([("s", i, i * 10, 5, i == 8) for i in range(12)] + [("open", i, i * 10, 5, False) for i in range(3)], "id string, seq long, at long, size int, last boolean")
    joins = spark.createDataFrame([("early", "s", -1), ("mid", "s", 35), ("late", "s", 500), ("o", "open", 12), ("none", "x", 0)], "subscriber string, id string, joined long")
    got = S.subscriptions(events, joins, "id", 1_000_000, 25).collect()
    seqs = lambda who: sorted(r.seq for r in got if r.subscriber == who and r.seq is not None)
    assert seqs("early") == seqs("mid") == seqs("late") == list(range(9)) and seqs("o") == [0, 1, 2] and seqs("none") == []
    assert {(r.seq, r.kind) for r in got if r.subscriber == "mid" and r.seq is not None} == {(i, "replay" if i <= 3 else "live") for i in range(9)}
    assert sorted(r.at for r in got if r.kind == "keepalive" and r.subscriber in ("early", "mid")) == [24, 49, 60, 74] and not any(r.kind == "keepalive" for r in got if r.subscriber == "late")
    small = S.subscriptions(events, joins, "id", 12, 25).where("subscriber = 'late'").collect()
    assert sorted(r.seq for r in small) == [7, 8] and S.subscriptions(events.limit(0), joins, "id").count() == 0


def test_a_snapshot_and_its_stream_overlap_without_loss_or_repeat(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, f"{k}{i}") for k in "abc" for i in range(20)], "id string, seq long, said string")
    snapshot = rows.where("(id = 'a' and seq < 7) or (id = 'b' and seq < 20)")
    files = [rows.where((F.col("seq") >= 5 * i) & (F.col("seq") < 5 * i + 5)) for i in range(4)]
    live = streamed(spark, files, rows.schema, lambda s: stitch.live_after(s, snapshot, "id", "seq"), tmp_path, "live")
    assert rows_of(snapshot.unionByName(live)) == rows_of(rows)


def test_early_end_sees_marks_across_chunks(spark):
    rows = spark.createDataFrame([("a", i, c) for i, c in enumerate("xx{boot}yy")] + [("b", 0, None), ("b", 1, "é" * 4), ("b", 2, "stop"), ("b", 3, "more"), ("c", 0, "")], "k string, i int, chunk string")
    read = S.early_ended(rows, "k", "i", "chunk", 5, (("{boot", "}"), ("stop",)))
    assert rows_of(read.where("k = 'a'"))[-1] == ("a", 7, 8, True) and read.where("k = 'a'").count() == 8
    assert rows_of(read.where("k <> 'a'")) == [("b", 0, 0, False), ("b", 1, 8, False), ("b", 2, 12, True), ("c", 0, 0, False)]


def test_media_index_learns_sums(spark):
    index = spark.createDataFrame([("https://a/1", 5, None, 0, 0, None), ("https://a/2", 5, "x", 0, 0, None)], "url string, size_bytes long, sha256 string, created_at long, last_accessed_at long, expires_at long")
    files = spark.createDataFrame([("https://a/1", 5, "s1"), ("https://a/2", 5, "y")], "url string, size_bytes long, sha256 string")
    found = D.read(index, files, index.select("url"), 9, "hash")
    assert {r.url: r.status for r in found.collect()} == {"https://a/1": "hit", "https://a/2": "changed"}
    assert [tuple(r) for r in D.after_read(index, found, 9).collect()] == [("https://a/1", 5, "s1", 0, 9, None)]
    assert [r.sha256 for r in D.after_read(index, D.read(index, files, index.select("url"), 9), 9).orderBy("url").collect()] == [None, "x"]


def test_the_longest_continuation():
    rnd = random.Random(4)
    for _ in range(20_000):
        head, tail = ("".join(rnd.choice("aab") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        assert scan.continued(head, tail) == max(n for n in range(len(head) + 1) if tail.endswith(head[:n]))
    began = time.perf_counter()
    assert scan.continued("a" * 2047 + "b", "a" * 2048) == 2047 and scan.continued("aaab" * 512, "aaab" * 511 + "aaac") == 0
    assert time.perf_counter() - began < 0.2


def test_merged_chunks_of_the_table_equal_a_direct_fold(spark, sf):
    talks = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.text))
    want = set()
    for k, turns in talks.items():
        text = ""
        for turn, chunk in turns:
            head = next((i for i, (a, b) in enumerate(zip(text, chunk)) if a != b), min(len(text), len(chunk)))
            if head == len(chunk) and text:
                added = ""
            elif head == len(text) or len(chunk) >= len(text) and min(head, 4096) >= max(len(text) - 64, int(len(text) * 0.9), 1):
                added, text = chunk[head if head == len(text) else min(head, 4096) :], chunk
            else:
                added = chunk[max(n for n in range(min(len(text), len(chunk), 2048) + 1) if text.endswith(chunk[:n])) :]
                text += added
            want.add((k, turn, len(added), len(text)))
    assert {(r.conv_id, r.turn, r.appended, r.total) for r in catalog.QUERIES["stream_merge"](spark, sf).collect()} == want
