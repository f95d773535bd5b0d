import collections
import random

from loomtext.llm.packing import pack, pack_shard, packed_texts


def brute(ids, sizes, sources, clusters, capacity):
    """Best-fit over a plain list of bins; of equal rooms the one filled last."""
    bins, where = [], {}
    for step, i in enumerate(sorted(range(len(ids)), key=lambda i: (-sizes[i], ids[i], sources[i] or ""))):
        fits = [b for b in bins if b[0] >= sizes[i] and (sources[i] is None or sources[i] not in b[1]) and (clusters[i] is None or clusters[i] not in b[2])]
        b = min(fits, key=lambda b: (b[0], -b[3])) if fits else [capacity, set(), set(), 0, len(bins)]
        if not fits:
            bins.append(b)
        where[i] = (b[4], capacity - b[0])
        b[0] -= sizes[i]
        b[1].add(sources[i])
        b[2].add(clusters[i])
        b[3] = step
    return where


def test_shard_takes_the_tightest_compatible_bin():
    rnd = random.Random(1)
    for n in (0, 1, 50, 700):
        ids, sizes = list(range(n)), [rnd.randint(1, 100) for _ in range(n)]
        sources = [rnd.choice([None, "hot", "hot", "hot", *map(str, range(70))]) for _ in ids]
        clusters = [rnd.choice([None, 1, *range(2, 300)]) for _ in ids]
        to, at = pack_shard(ids, sizes, sources, clusters, 100)
        members = collections.defaultdict(list)
        for i in ids:
            members[to[i]].append(i)
        for m in members.values():
            m.sort(key=lambda i: at[i])
            assert [at[i] for i in m] == [sum(sizes[j] for j in m[:k]) for k in range(len(m))]
            assert sum(sizes[i] for i in m) <= 100
            for keys in (sources, clusters):
                own = [keys[i] for i in m if keys[i] is not None]
                assert len(own) == len(set(own))
        assert brute(ids, sizes, sources, clusters, 100) == {i: (to[i], at[i]) for i in ids}


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", "xyz", "s"), ("a", "xyzw", "s"), (None, "q", "t")], "doc_id string, text string, source string")
    assert {(r.doc_id, r.start, r.end) for r in pack(df, capacity=10).collect()} == {("b", 0, 3), ("a", 0, 4), (None, 0, 1)}


def test_pieces_cover_texts_and_rebuild(spark):
    rows = [(1, "é" * 25, "a", 0), (2, None, "a", 0), (3, "", "b", 0), (4, "x" * 10, "a", 0), (5, "abc", None, 0), (6, "abc", "b", 0), (7, "12345", "b", 0), (8, "q" * 1000, "c", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin int")
    pieces = pack(df, capacity=10, shard_rows=3)
    got = collections.defaultdict(str)
    texts = {r[0]: r[1] for r in rows}
    for r in sorted(pieces.collect(), key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] += texts[r.doc_id][r.start : r.end]
    assert got == {k: t for k, t in texts.items() if t}
    bins = packed_texts(df, pieces, separator="").collect()
    assert sum(len(b.text) for b in bins) == sum(len(t or "") for t in texts.values()) and max(b.n_chars for b in bins) <= 10
    assert pack(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "abc", "a")] * 4 + [(None, "abc", "a")], "doc_id long, text string, source string")
    assert len({r.bin_id for r in pack(same).collect()}) == 5


def test_texts_of_null_and_repeated_ids(spark):
    big = 2**60 + 1
    rows = [(None, "n" * 12, "a"), (None, "m" * 7, "b"), (None, "m" * 7, "c"), (1, "x" * 25, "a"), (1, "x" * 25, "a"), (1, "y" * 4, "b"), (big, "z" * 3, "c"), (2, "", "c"), (3, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bins = packed_texts(df, pack(df, capacity=10), separator="").collect()
    assert all(b.n_chars == len(b.text) <= 10 for b in bins)
    assert collections.Counter("".join(b.text for b in bins)) == collections.Counter("".join(t or "" for _, t, _ in rows))
    assert collections.Counter(i for b in bins for i in b.doc_ids) == {None: 4, 1: 7, big: 1}
