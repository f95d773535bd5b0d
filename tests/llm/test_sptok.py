import hashlib
import random

import numpy as np
import pytest

from loomtext.llm.lattice import SPACE
from loomtext.llm.sptok import Codec, decode_column, encode_column, nbest_digests


@pytest.fixture(scope="module")
def codec():
    return Codec()


def all_paths(codec, text):
    """Every path of a short text over the whole lattice, best first."""
    s = SPACE + text.replace(" ", SPACE)

    def walk(i):
        if i == len(s):
            yield 0.0, ()
            return
        for j in range(i + 1, min(len(s), i + codec.longest) + 1):
            k = codec.index.get(s[i:j])
            if k is not None:
                step = (float(codec.scores[k]), (int(codec.ids[k]),))
            elif j == i + 1:
                step = (float(codec.scores[-1]), tuple(codec.byte_ids(s[i])))
            else:
                continue
            for score, ids in walk(j):
                yield score + step[0], step[1] + ids

    return sorted(walk(0), key=lambda x: -x[0])


def test_nbest_equal_brute_force(codec):
    rnd = random.Random(1)
    texts = ["a", "the", "the cat", "  a  b", "xéz\n", "aaaaaa", "漢字", "on on on", " ", "hello wor"] + ["".join(rnd.choice("ab th é") for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    for text, got in zip(texts, codec.encode(texts, 6)):
        want = all_paths(codec, text)
        assert [s for s, _ in got] == [s for s, _ in want[:6]], text
        ids = [tuple(i.tolist()) for _, i in got]
        assert len(set(ids)) == len(ids) and {(s, i) for (s, _), i in zip(got, ids)} <= set(want)
        assert all(codec.decode(i) == text for i in ids)


def test_round_trip_of_anything(codec):
    rnd = random.Random(2)
    texts = ["", SPACE, f"a{SPACE} {SPACE}{SPACE}b", "\0\0", "\n" + SPACE, "🦊 tab\t", "x" * 3000, " " * 100]
    texts += ["".join(rnd.choice(["▁", " ", "a", "the", "\n", "\0", "é", "漢", "🦊", " "]) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    for text, paths in zip(texts, codec.encode(texts)):
        assert all(codec.decode(ids) == text for _, ids in paths)
        scores = [s for s, _ in paths]
        assert scores == sorted(scores, reverse=True)


def test_cache_does_not_change_results(codec, monkeypatch):
    texts = [f"word{i} and others of {i * i}" for i in range(200)]
    a = codec.encode(texts)
    monkeypatch.setattr("loomtext.llm.sptok.CACHE_CHUNKS", 50)
    b = [codec.encode([t])[0] for t in texts]
    assert all(s == t and np.array_equal(i, j) for x, y in zip(a, b) for (s, i), (t, j) in zip(x, y))


def test_rows(spark, codec):
    long = "many words again " * 60_000
    rows = [(1, None, 0), (2, "", 0), (3, "the cat", 0), (3, "the cat", 0), (None, long, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = nbest_digests(df).collect()
    assert got[0].n_pieces == 0 and got[0].nbest == [] and got[0].round_trip is None
    assert got[1].n_pieces == 0 and got[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and got[1].score == 0
    assert got[2] == got[3] and len(got[2].nbest) == 4 and all(r.round_trip for r in got[1:])
    ids = encode_column(df)
    assert [r.text for r in decode_column(ids).collect()] == [r[1] for r in rows]
    assert nbest_digests(df.limit(0)).count() == 0
