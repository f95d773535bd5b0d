import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.operators.chains import Step, joined, ledger, resolve
from loomtext.plans import fetching, transcripts
from loomtext.sources.files import answered


def asked_about(spark, values, note=None):
    """A service that knows some rows, and the ids it was asked about, counted on the executors."""
    seen = spark.sparkContext.accumulator(0)

    def serve(batch: pd.DataFrame) -> pd.DataFrame:
        seen.add(len(batch))
        batch["value"] = [values.get(i) for i in batch["id"]]
        batch["note"] = note
        return batch

    return (lambda rows: answered(rows, serve, rows.schema)), seen


def test_each_service_sees_exactly_the_rows_left(spark):
    rows = spark.range(10).repartition(3)
    (first, n1), (second, n2), (third, n3) = (asked_about(spark, v, note) for v, note in (({1: "a", 2: " ", 3: ""}, "first"), ({2: "b", 4: "c"}, None), ({i: "d" for i in range(10)}, "third")))
    steps = [Step("one", first), Step("two", second, F.col("id") != 4), Step("look", lambda r: r.withColumn("settled", F.col("id") == 9), quiet=True), Step("three", third, F.when(F.col("id") > 7, None).otherwise(F.col("id") != 5))]
    out = resolve(rows, steps)
    got = {r.id: (r.value, r.provider, r.attempted, r.notes) for r in out.collect()}
    assert (n1.value, n2.value, n3.value) == (10, 8, 5)
    assert got[1] == ("a", "one", ["one"], ["first"]) and got[2] == ("b", "two", ["one", "two"], ["first"]) and got[4] == ("d", "three", ["one", "three"], ["first", "third"])
    assert got[5] == (None, None, ["one", "two"], ["first"]) == got[8] == got[9] and got[3][0] == "d" and len(got) == 10
    assert {tuple(r) for r in ledger(out).collect()} == {("one", 10, 1), ("two", 8, 1), ("three", 5, 5)}
    assert resolve(rows.limit(0), steps).count() == 0 and ledger(resolve(rows.limit(0), steps)).count() == 0


def test_partitions_do_not_add_up(spark):
    nothing = lambda rows: rows
    out = resolve(spark.range(100).repartition(8), [Step(f"s{i}", nothing, F.col("id") % 2 == i % 2) for i in range(8)])
    assert out.where("not settled").count() == 100 and out.rdd.getNumPartitions() <= 200


def test_answers_from_a_table(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (None, "z")], "id long, fact string")
    table = spark.createDataFrame([(1, "v1", None), (2, None, "f2")], "id long, value string, fact string")
    got = sorted((tuple(r) for r in resolve(rows.select("id"), [Step("t", joined(table, "id"))], {"fact": "string"}).select("id", "value", "fact").collect()), key=repr)
    assert got == sorted([(1, "v1", None), (2, None, "f2"), (2, None, "f2"), (None, None, None)], key=repr)


@pytest.mark.parametrize("answer, problem", [
    ((200, "text/html; charset=utf-8", None), None), ((200, None, None), None), ((200, " ", None), None), ((299, "TEXT/plain", None), None), ((200, "application/xhtml+xml", None), None), ((200, "application/rss+xml", None), None),
    ((200, "application/pdf", None), "content type application/pdf"), ((200, "image/png", None), "content type image/png"), ((199, "text/html", None), "status 199"), ((301, "text/html", None), "status 301"), ((404, "text/html", None), "status 404"), ((503, None, None), "status 503"),
    ((None, None, None), "no answer"), ((None, None, "The operation was aborted"), "timed out"), ((None, None, "Timed out"), "timed out"), ((200, "text/html", "ZlibError"), "ZlibError"),
])
def test_answers_that_are_no_page(spark, answer, problem):
    row = spark.createDataFrame([answer], "status int, kind string, failure string")
    assert row.select(fetching.answer_problem(F.col("status"), F.col("kind"), F.col("failure"))).first()[0] == problem


def test_broken_compression_is_asked_again_once(spark):
    pages = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3"), (4, None)], "id long, url string")
    fetch = lambda identity: lambda rows: rows.withColumns({"status": F.lit(200), "body": F.lit("page"), "failure": F.when((F.col("id") == 2) & F.lit(not identity), "ShortRead").when(F.col("id") == 3, "zlib: bad data")})
    dead = lambda rows: rows.withColumns({"failure": F.lit("down"), "body": F.lit("lost")})
    got = {r.id: (r.value, r.provider, r.attempted, r.problem, r.final_url) for r in fetching.fetched(pages, fetch, {"s1": dead, "s2": lambda rows: rows.withColumn("body", F.lit("# text"))}).collect()}
    assert got[1] == ("page", "compressed", ["compressed"], None, "u1") and got[2] == ("page", "identity", ["compressed", "identity"], None, "u2")
    assert got[3] == ("# text", "s2", ["compressed", "identity", "s1", "s2"], "zlib: bad data", "u3") and got[4][0] == "page"


def test_sound_goes_on_only_with_keys(spark):
    rows = spark.createDataFrame([(1, ["openai", "fal"], "audio/wav"), (2, ["fal"], "video/mp4"), (3, None, "audio/wav"), (4, [], None)], "id long, keys array<string>, kind string")
    down = {n: (lambda n: lambda r: r.withColumn("failure", F.lit(f"{n} down")))(n) for n in ("groq", "assemblyai", "gemini", "openai", "fal")}
    got = {r.id: (r.attempted, r.notes, r.failed, r.value) for r in resolve(rows, transcripts.audio_steps(down, F.col("keys"), F.col("kind")), transcripts.AUDIO_FACTS).collect()}
    assert got[1] == (["openai", "fal"], ["OpenAI transcription failed; falling back to FAL: openai down"], "fal", None)
    assert got[2] == got[3] == got[4] == ([], [], None, None)
