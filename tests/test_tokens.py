import base64
import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T, tokens

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_equal_a_direct_definition(ranks):
    rnd = random.Random(2)
    small = {bytes([c]): i for i, c in enumerate(b"abc")} | {b"ab": 3, b"bc": 4, b"abc": 5, b"aa": 6, b"aab": 7, b"abab": 8}
    for vocabulary, letters in ((small, "abcd"), (ranks, "the ingaé")):
        for _ in range(2000):
            piece = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))).encode()
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 1:
                best = min(((vocabulary[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in vocabulary), default=None)
                if best is None:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            got = tokens.merged_parts(piece, vocabulary)
            assert b"".join(got) == piece and (got == parts or piece in vocabulary and got == [piece])


def test_counts_equal_the_library(spark, library):
    columns = tokens.TokenColumns(spark, tokens.read_ranks(spark, PATH))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.n for r in docs.select("doc_id", columns.count(F.col("text")).alias("n")).collect()}
    assert got == {r.doc_id: len(library.encode_ordinary(r.text)) for r in docs.collect()}


def test_long_pieces_odd_texts_and_nulls(spark, ranks, library):
    own = tokens.Tokens(ranks)
    for text in ("", " ", "\n\n\n", "日本語 テキスト 🙂🙂", "x" * 30_000, "ab" * 20_000, "á​\t b  c"):
        assert own.count(text) == len(library.encode_ordinary(text))
    columns = tokens.TokenColumns(spark, ranks)
    df = spark.createDataFrame([(None, 5), ("a b", None), ("a b", 5)], "t string, m int")
    assert [tuple(r) for r in df.select(columns.count(F.col("t")), columns.fitted(F.col("t"), F.col("m"))).collect()] == [(None, None), (2, None), (2, "a b")]


def test_texts_are_cut_to_their_budget(spark, ranks, library):
    own, rnd = tokens.Tokens(ranks), random.Random(7)
    for _ in range(200):
        text = " ".join(rnd.choice(["word.", "Über", "x1", "end!\n", "日本"]) for _ in range(rnd.randint(1, 400)))
        most = rnd.randint(1, 300)
        out = own.fitted(text, most)
        assert out == text if own.count(text) <= most else own.count(out) <= max(most, 20)
        assert len(out) <= len(text) or len(text) < 100


def test_one_string_is_cut_as_a_column_is(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["Word ", "end. ", "yes! ", "no? ", "line\n", " ", "é"]) for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for most in (1, 40, 300, 500, 5000):
        got = {r.i: r.c for r in df.select("i", T.clip_head_and_tail(F.col("t"), most).alias("c")).collect()}
        assert got == {i: tokens.head_and_tail(t, most) for i, t in enumerate(texts)}


def test_query_over_the_table(spark, sf, ranks, library):
    from loomtext.plans import catalog

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    own = tokens.Tokens(ranks)
    for r in catalog.QUERIES["token_counts"](spark, sf).collect():
        assert r.n_tokens == len(library.encode_ordinary(texts[r.doc_id]))
        assert r.cut_chars == len(own.fitted(texts[r.doc_id], 200)) and (r.n_tokens > 200) == (r.cut_chars < len(texts[r.doc_id]))


def test_short_pieces_merge_as_long_ones(ranks):
    rnd = random.Random(3)
    for _ in range(5000):
        piece = "".join(rnd.choice("the ingaéß日🙂") for _ in range(rnd.randint(0, 24))).encode()
        assert tokens.short_parts(piece, ranks) == tokens.merged_parts(piece, ranks)


def test_a_text_is_counted_once(spark, ranks, library):
    own, counted = tokens.Tokens(ranks), []
    count, own.count = own.count, lambda t: counted.append(t) or count(t)
    text = "Some words of it. " * 400
    assert own.fitted(text, 50, count(text)) == tokens.Tokens(ranks).fitted(text, 50) and text not in counted
    columns = tokens.TokenColumns(spark, ranks)
    texts = [None, "", "a b", text, "x" * 2_000_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", columns.counted(F.col("t"), F.lit(60)).alias("c"), columns.count(F.col("t")).alias("n"), columns.fitted(F.col("t"), F.lit(60)).alias("cut")).collect():
        assert (r.c.n, r.c.cut) == (r.n, r.cut) and r.n == (None if r.t is None else len(library.encode_ordinary(r.t)) if len(r.t) < 100_000 else r.n)
