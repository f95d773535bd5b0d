import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from loomtext.llm import resampling as R
from loomtext.llm.words import word_runs
from tests.compare import duck_rows, spark_rows


def features(text, grams=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, buckets=10_000, percent=25, least=20, grams=2):
    """Sorted rows of the draw; null ids last, ties by number of features."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in docs for f in features(t, grams)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x, grams)[1])
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for key, text in docs:
        words, own = features(text, grams)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, own)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(out):
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 5, 64, 1 << 20])
def test_pieces_have_the_words_and_features_of_the_whole(size, monkeypatch):
    rnd = random.Random(size)
    monkeypatch.setattr(R, "word_runs", lambda data: word_runs(data, size))
    for grams in (1, 2, 3, 4):
        for _ in range(60):
            text = "".join(rnd.choice(["A", "b", "é", "7", " ", "-", "\n", "Zeta", "日本"]) for _ in range(rnd.randint(0, 60)))
            parts = list(R.hashes(text.encode(), grams))
            words, own = features(text, grams)
            assert sum(n for n, _ in parts) == len(words)
            assert collections.Counter(c for _, x in parts for c in x.tolist()) == collections.Counter(zlib.crc32(f.encode()) for f in own)


def test_equals_brute_force(spark):
    rnd = random.Random(1)
    text = lambda n: " ".join(rnd.choice(["The", "of", "Édit", "x1", "a-b", "tail", "rare%d" % rnd.randint(0, 40)]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(300)] + [(900, None), (901, ""), (902, "?!")]
    docs += [(i, "copied words of one text " * 6) for i in range(1000, 1200)] + [(None, text(30)), (None, text(50)), (7, docs[7][1]), (7, docs[7][1])]
    target = [text(20) + " tail tail", None, ""]
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, score int, rank string").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(R.resample(frame, bench)) == brute(docs, target)
    assert got(R.resample(frame, bench, buckets=64, percent=100, least_words=0, grams=3)) == brute(docs, target, 64, 100, 0, 3)
    assert got(R.resample(frame, bench.limit(0))) == brute(docs, [])
    assert got(R.resample(frame.limit(0), bench)) == []


def test_long_text(spark):
    docs = [(1, "long words " * 300_000), (2, "short " * 30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(R.resample(frame, frame.limit(0), percent=50)) == brute(docs, [], percent=50)


def test_equals_sql(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    assert spark_rows(R.resample(docs, bench)) == duck_rows(R.oracle_sql(), sf)
