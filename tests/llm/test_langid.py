import zlib
from decimal import Decimal

import numpy as np

from loomtext.llm.langid import SCALE, UNKNOWN, LanguageModel, expected_counts, language_id, word_scores
from loomtext.llm.lattice import SPACE, Lattice


def model():
    pieces = [SPACE, "a", "b", "ab", SPACE + "a", "ba", SPACE + "ab"]
    return LanguageModel.of(["x", "y"], pieces, np.array([[3, 1], [2, 5], [1, 1], [4, 0], [2, 2], [0, 3], [1, 1]], float))


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or n == 1:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def brute(m, word):
    """Sum over all segmentations, and expected uses of each piece."""
    p = {x: m.weights[i] / SCALE ** len(x) for i, x in enumerate(m.pieces)}
    total, uses = np.zeros(2), {x: np.zeros(2) for x in m.pieces}
    for parts in segmentations(SPACE + word, p):
        value = np.prod([p.get(x, np.full(2, UNKNOWN)) for x in parts], axis=0)
        total += value
        for x in parts:
            if x in uses:
                uses[x] += value
    return total, {x: u / total for x, u in uses.items()}


def test_forward_sums_all_segmentations_and_em_counts_them():
    m = model()
    lattice = Lattice(m.pieces)
    words = ["ab", "abab", "aéb", "b", "babba", "a" * 9]
    got = word_scores(lattice, m.weights, words)
    counts = expected_counts(lattice, m.weights, words, np.ones((len(words), 2)))
    want = sum(np.array([brute(m, w)[1][p] for p in m.pieces]) for w in words)
    assert np.allclose(got, [np.log(brute(m, w)[0]) for w in words])
    assert np.allclose(counts[: len(m.pieces)], want)


def exact_sums(m, word, lang):
    """Sums over all segmentations of each beginning and each end, in decimals, and uses of each piece."""
    word = SPACE + word
    p = {x: Decimal(float(m.weights[i][lang])) / Decimal(SCALE) ** len(x) for i, x in enumerate(m.pieces)}
    odd, spans = Decimal(UNKNOWN), [(i, j) for i in range(len(word)) for j in range(i + 1, min(len(word), i + 3) + 1)]
    value = {(i, j): p.get(word[i:j], odd if j == i + 1 else Decimal(0)) for i, j in spans}
    head, tail = [Decimal(1)] + [Decimal(0)] * len(word), [Decimal(0)] * len(word) + [Decimal(1)]
    for j in range(1, len(word) + 1):
        head[j] = sum(head[i] * value[i, j] for i in range(max(0, j - 3), j))
    for i in reversed(range(len(word))):
        tail[i] = sum(tail[j] * value[i, j] for j in range(i + 1, min(len(word), i + 3) + 1))
    uses = [sum(float(head[i] * value[i, j] * tail[j] / head[-1]) for i, j in spans if word[i:j] == x) for x in m.pieces]
    return float(head[-1].ln()), uses


def test_long_words_sum_all_segmentations():
    m = model()
    lattice, words = Lattice(m.pieces), ["ab" * 60, "ba" * 23 + "b", "é" * 300 + "abba" * 200, "a" * 31, "b" * 32, "ab" * 33]
    got, counts = word_scores(lattice, m.weights, words), expected_counts(lattice, m.weights, words, np.ones((len(words), 2)))
    for lang in (0, 1):
        sums = [exact_sums(m, w, lang) for w in words]
        assert np.allclose(got[:, lang], [s for s, _ in sums])
        assert np.allclose(counts[: len(m.pieces), lang], np.sum([u for _, u in sums], axis=0))


def test_very_long_words_do_not_underflow():
    m = model()
    assert np.isfinite(word_scores(Lattice(m.pieces), m.weights, ["é" * 5000 + "ab" * 3000])).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id(docs, train_docs=100).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert len(rows) == 1000 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_predictions_do_not_depend_on_id_lang_or_source(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = docs.where("doc_id >= 20")
    probe = docs.where("doc_id < 20").selectExpr("doc_id + 100000 as doc_id", "text", "cast(null as string) as lang", "'?' as source", "n_chars")
    a = language_id(train.union(docs.where("doc_id < 20").withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))))
    b = language_id(train.union(probe))
    left = {r.doc_id: (r.lang_pred, r.score) for r in a.collect() if r.doc_id < 20}
    right = {r.doc_id - 100000: (r.lang_pred, r.score) for r in b.collect() if r.doc_id >= 100000}
    assert left == right


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", 1), (1, "the cat and the dog", "en", 1), (2, None, "en", 1), (3, "12 34 !", None, 1), (4, "", None, 1), (None, "the cat", None, 1), (6, "der Hund und die Katze", "de", 1), (7, "das ist der Hund", "de", 2), (8, "Hund " * 200_000, None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in language_id(df).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[2].score == 0
    assert got[8].lang_pred == "de" and got[None].held_out is False
    assert language_id(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id(df.withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))).collect()} == {"und"}
