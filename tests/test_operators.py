import random

from pyspark.sql import functions as F

from loomtext.functions import scan
from loomtext.operators import cache as C, metrics as M, routing as R, streams as S, timeline as L
from loomtext.sources import files
from loomtext.streaming import stitch

CACHE = "kind string, key string, value string, size_bytes long, created_at long, last_accessed_at long, expires_at long"


def test_cache_reads_writes_and_size(spark):
    rows = [("a", "1", "x", 50, 0, 10, None), ("a", "2", "y", 50, 0, 20, 100), ("b", "1", "z", 10, 0, 5, 1000)]
    cache = spark.createDataFrame(rows, CACHE)
    wanted = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "9")], "kind string, key string")
    assert {(r.key, r.status) for r in C.read(cache, wanted, 100).collect()} == {("1", "hit"), ("2", "expired"), ("9", "miss")}
    after = {(r.kind, r.key): r.last_accessed_at for r in C.touched(cache, wanted, 100).collect()}
    assert after == {("a", "1"): 100, ("b", "1"): 5}
    entry = spark.createDataFrame([("a", "1", "new", 50, 7)], "kind string, key string, value string, size_bytes long, ttl_ms long")
    now = {(r.kind, r.key): (r.value, r.expires_at) for r in C.written(cache, entry, 150).collect()}
    assert now == {("a", "1"): ("new", 157), ("b", "1"): ("z", 1000)}
    assert [(r.kind, r.key) for r in C.within_size(cache, 60).collect()] == [("a", "2")]
    assert C.within_size(cache, 0).count() == 3 and C.within_size(cache.limit(0), 5).count() == 0
    assert {r.key for r in C.misses(wanted, cache, 100).collect()} == {"2", "9"}
    fresh = spark.createDataFrame([("a", "1", None, "miss"), ("a", "7", None, "miss")], "kind string, key string, value string, status string")
    assert {(r.key, r.value, r.status) for r in C.with_stale_fallback(fresh, cache).collect()} == {("1", "x", "fallback"), ("7", None, "miss")}


def test_cache_keeps_the_longest_newest_suffix(spark):
    rnd = random.Random(1)
    rows = [("k", str(i), "", rnd.randint(1, 50), 0, rnd.randint(0, 400), None) for i in range(300)]
    kept = {r.key for r in C.within_size(spark.createDataFrame(rows, CACHE), 3000, buckets=7).collect()}
    total, want = 0, set()
    for r in sorted(rows, key=lambda r: (-r[5], r[0], r[1])):
        total += r[3]
        if total > 3000:
            break
        want.add(r[1])
    assert kept == want


def test_summary_cache_prefers_the_selection_key(spark):
    cache = spark.createDataFrame([("s", "k1", "one", 1, 0, 0, None), ("s", "k2", "two", 1, 0, 0, None)], CACHE)
    requests = spark.createDataFrame([(1, "k1"), (2, "no"), (3, "no")], "id int, selection_key string")
    candidates = spark.createDataFrame([(1, 0, "k2"), (2, 0, "x"), (2, 1, "k2")], "id int, pos int, key string")
    assert {(r.id, r.value, r.pos) for r in C.first_cached(requests, candidates, cache).collect()} == {(1, "one", None), (2, "two", 1), (3, None, None)}


def test_usage_nulls_and_costs(spark):
    calls = spark.createDataFrame([("p", "m", None, 1, None), ("p", "m", None, 2, 0.5), ("p", "n", 1, None, float("nan"))], "provider string, model string, prompt_tokens long, completion_tokens long, cost_usd double").withColumn("total_tokens", F.lit(None).cast("long"))
    got = {r.model: r for r in M.usage_by_model(calls).collect()}
    assert (got["m"].calls, got["m"].prompt_tokens, got["m"].completion_tokens) == (2, None, 3) and got["n"].completion_tokens is None
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_usd_per_token double, output_usd_per_token double")
    assert {(r.model, r.cost) for r in M.total_cost(calls, prices, ["model"]).collect()} == {("m", 0.5), ("n", None)}
    kinds = M.failure_histogram(spark.createDataFrame([("Rate limit exceeded",), ("x",)], "m string"), "m").first()
    assert kinds.rate_limit_minute == 1 and kinds.other == 1 and kinds.timeout == 0


def test_gateway_matching_is_unique_or_null(spark):
    catalog = spark.createDataFrame([("OpenAI/gpt-5",), ("x-ai/grok-4.1-fast",), ("a/dup",), ("b/dup",), ("noslash",)], "id string")
    models = spark.createDataFrame([("openai/gpt-5",), ("xai/grok-4-1-fast",), ("openai/dup",), ("openai/none",)], "model string")
    assert {r.model: r.gateway for r in R.gateway_ids(models, catalog).collect()} == {"openai/gpt-5": "OpenAI/gpt-5", "xai/grok-4-1-fast": "x-ai/grok-4.1-fast", "openai/dup": None, "openai/none": None}


def test_attempts(spark):
    cand = spark.createDataFrame([(1, p, c, 500) for p, c in enumerate(["cli/claude", "openai/a", "gemini-x", "openai/a", "xai/small"])], "id int, pos int, candidate string, tokens long")
    limits = spark.createDataFrame([("xai/small", 100), ("openai/a", 900)], "model string, max_input_tokens long")
    gateways = spark.createDataFrame([("openai/a", "OpenAI/a")], "model string, gateway string")
    got = [(r.pos, r.transport, r.model, r.has_key) for r in sorted(R.attempts(cand, limits, gateways, ("OPENAI_API_KEY",)).collect(), key=lambda r: r.pos)]
    assert got == [(0, "native", "openai/a", True), (1, "openrouter", "openrouter/OpenAI/a", False), (2, "native", "google/gemini-x", False)]
    assert [r.model for r in R.attempts(cand, limits, video=True).collect()] == ["google/gemini-x"]


def test_chain_success_and_lists(spark):
    rows = spark.createDataFrame([(1, None, "b"), (2, " ", None)], "id int, one string, two string")
    assert [(r.value, r.provider, r.attempted) for r in R.chain(rows, ("one", "two")).orderBy("id").collect()] == [("b", "two", ["one", "two"]), (None, None, ["one", "two"])]
    results = spark.createDataFrame([(1, 0, "a", False, None), (1, 1, "b", True, "v"), (1, 2, "c", True, "w")], "id int, pos int, model string, ok boolean, value string")
    assert R.first_success(results).first()[:3] == (1, "b", "v")
    fails = spark.createDataFrame([("m", ["c", "a"]), ("m", ["b", "a", "d"])], "model string, providers array<string>")
    assert R.provider_union(fails).first().label == "a, b, c (+1 more)"
    assert R.suggestions(spark.createDataFrame([("pro-3", 0), ("flash-3-preview", 1), ("flash-3", 2)], "id string, pos int"), 2).select("id").collect()[0][0] == "flash-3"


def test_merge_chunk():
    assert scan.merge_chunk("", "a\r\nb") == ("a\nb", "a\nb") and scan.merge_chunk("abc", "") == ("abc", "")
    assert scan.merge_chunk("abc", "abcd") == ("abcd", "d") and scan.merge_chunk("abcd", "ab") == ("abcd", "")
    assert scan.merge_chunk("hello wor", "world") == ("hello world", "ld") and scan.merge_chunk("ab", "xy") == ("abxy", "xy")
    long = "x" * 100 + "."
    assert scan.merge_chunk(long, "x" * 100 + "!?")[0] == "x" * 100 + "!?"
    rnd = random.Random(3)
    for _ in range(300):
        head, tail = ("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(2))
        assert scan.continued(head, tail) == max(k for k in range(min(len(head), len(tail)) + 1) if tail.endswith(head[:k]))
        text = "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 40)))
        now = ""
        for i in range(1, len(text) + 1):
            now, _ = scan.merge_chunk(now, text[:i])
        assert now == text


def test_output_gate():
    assert scan.gate(["a", "a\nb", "a\nb\nc"], True) == ["", "a\n", "b\n"]
    assert scan.gate(["a", "ab", "xb"], False) == ["a", "b", "xb"] and scan.gate(["\n\na"], False) == ["a"]


def test_streaming_equals_batch(spark, tmp_path):
    texts = {"s1": ["he", "hello", "lo you", "hello you!"], "s2": ["a", "b", "b"]}
    rows = [(k, i, c) for k, v in texts.items() for i, c in enumerate(v)]
    schema = "stream_id string, seq long, chunk string"
    for n in range(2):
        spark.createDataFrame([r for r in rows if (r[1] >= 2) == bool(n)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stitch.stitched(source).writeStream.format("memory").queryName("stitched").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    texts = {(r.stream_id, r.seq): r.text for r in spark.sql("SELECT * FROM stitched").collect()}
    got = {(r.stream_id, r.seq): (r.appended, len(r.text)) for r in spark.sql("SELECT * FROM stitched").collect()}
    want = {(r.stream_id, r.seq): (r.appended, r.total) for r in S.merged_chunks(spark.createDataFrame(rows, schema), "stream_id", "seq", "chunk").collect()}
    assert got == want and texts[("s1", 3)] == "hello you!"


def test_session_events(spark):
    rows = [("s", 0, "meta", 5), ("s", 1, "chunk", 5), ("s", 2, "done", 5), ("s", 3, "chunk", 5)]
    events = spark.createDataFrame(rows, "id string, seq int, event string, size int")
    assert S.open_events(events, "id", "seq", "event").count() == 3
    assert [r.seq for r in S.buffered(events, "id", "seq", "size", 10).orderBy("seq").collect()] == [2, 3]
    lines = spark.createDataFrame([("p", i, "x" * 30) for i in range(10)], "id string, seq int, line string")
    kept = S.log_ring(lines, "id", "seq", "line", 4, 7).collect()
    assert {r.seq for r in kept} == {6, 7, 8, 9} and {r.line for r in kept} == {"x" * 7}
    updates = spark.createDataFrame([("s", 1, "a", 1.0, 0), ("s", 1, " ", 2.0, 1)], "id string, index int, path string, at double, seq int")
    assert S.slide_state(updates, "id", "seq").first() == ("s", 1, "a", 2.0)


def test_ranges_and_asof(spark):
    points = spark.createDataFrame([("v", 1.0), ("v", 5.0), ("w", 5.0)], "id string, at double")
    starts = spark.createDataFrame([("v", 0.0), ("v", 5.0)], "id string, start double")
    assert {(r.id, r.at, r.start) for r in L.asof_segments(points, starts, "id").collect()} == {("v", 1.0, 0.0), ("v", 5.0, 5.0), ("w", 5.0, None)}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\nthree\n")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 \xff")
    got = {r.name: (r.media_type, r.text) for r in files.load_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("text/plain", "one\ntwo\nthree\n"), "b.pdf": ("application/pdf", None)}
    limited = {r.name: (r.bytes is None, r.problem) for r in files.load_files(spark, str(tmp_path), 12).collect()}
    assert limited == {"a.txt": (True, "too large"), "b.pdf": (False, None)}
    assert [r.line for r in files.log_tail(spark, str(tmp_path / "a.txt"), 2).orderBy("n").collect()] == ["two", "three"]
    assert [r.line for r in files.log_tail(spark, str(tmp_path / "a.txt"), 9, 8).orderBy("n").collect()] == ["three"]
    spooled = files.spooled(spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\0"),), (bytearray(b" "),)], "bytes binary"))
    assert [r.problem for r in spooled.collect()] == [None, "not text", "blank"]
    echo = files.answered(spark.createDataFrame([("x",)], "q string"), lambda b: b.assign(a=b.q + "!"), "q string, a string")
    assert echo.first().a == "x!"


def test_media_index_after_reads(spark):
    from loomtext.operators import media as D

    rows = [("https://a/1", 10, "s", 1, 1, None), ("https://a/2", None, None, 1, 1, 99), ("https://a/3", 10, "s", 1, 1, 5), ("https://a/4", 10, "s", 1, 1, None), ("https://a/5", 10, "s", 1, 1, None)]
    index = spark.createDataFrame(rows, "url string, size_bytes long, sha256 string, created_at long, last_accessed_at long, expires_at long")
    files = spark.createDataFrame([("https://a/1", 11, "s"), ("https://a/2", 7, "t"), ("https://a/3", 10, "s"), ("https://a/9", 1, "s")], "url string, size_bytes long, sha256 string")
    found = D.read(index, files, spark.createDataFrame([("https://a/1",), ("https://a/2",), ("https://a/2",), ("https://a/3",), ("https://a/4",), ("file:x",), (None,)], "url string"), 50)
    assert sorted((r.url or "", r.status) for r in found.collect()) == [("", "unfit"), ("file:x", "unfit"), ("https://a/1", "changed"), ("https://a/2", "hit"), ("https://a/2", "hit"), ("https://a/3", "expired"), ("https://a/4", "gone")]
    after = {r.url: (r.size_bytes, r.last_accessed_at) for r in D.after_read(index, found, 50).collect()}
    assert after == {"https://a/2": (7, 50), "https://a/5": (10, 1)}
    assert {r.url for r in D.stale_files(files, index).collect()} == {"https://a/9"} and D.written(index.limit(0), files.limit(0), 50, 10).count() == 0


def test_size_limit_in_crowded_access_times(spark):
    from loomtext.operators import cache as C

    times = [0, 10**12] + [5 * 10**11 + k // 3 for k in range(600)] + [None]
    rows = [("k", f"{i:04}", 1 + i % 5, t) for i, t in enumerate(times)]
    cache = spark.createDataFrame(rows, "kind string, key string, size_bytes long, last_accessed_at long")
    for most in (1, 40, 901, 5000):
        held, want = 0, set()
        for _, key, size, t in sorted((r for r in rows if r[3] is not None), key=lambda r: (-r[3], r[1])):
            held += size
            if held > most:
                break
            want.add(key)
        assert {r.key for r in C.within_size(cache, most, 4, 5).collect()} == want


def test_reports_and_slide_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "x")], "id int, text string")
    files.write_report(rows, str(tmp_path / "report"))
    lines = sorted(line for path in (tmp_path / "report").glob("*.json") for line in path.read_text().splitlines())
    assert lines == ['{"id":1,"text":null}', '{"id":2,"text":"x"}']
    slide = "array<struct<index:int,path:string>>"
    records = spark.createDataFrame([("a", 5, [(1, "p")]), ("b", 5, [(1, "p"), (2, None)]), ("c", 6, [(1, "p")]), ("d", None, [(1, "p")]), ("e", 5, [])], f"id string, most int, slides {slide}")
    assert {r.id for r in files.valid_slides(records, spark.createDataFrame([(5,)], "most int"), ["most"]).collect()} == {"a", "e"}
    assert {r.id for r in files.valid_slides(records, spark.createDataFrame([(None,)], "most int"), ["most"]).collect()} == {"d"}
