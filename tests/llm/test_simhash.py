import random

import xxhash

from loomtext.llm.components import connected_components
from loomtext.llm.simhash import entries, fingerprint, near_duplicates, segments_for, segments_of


def brute_fingerprint(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = {i: i for i in fps}
    change = True
    ids = sorted(fps)
    near = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    while change:
        change = False
        for a, b in near:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                change = True
    return label


def test_fingerprint():
    rnd = random.Random(1)
    for n in [0, 1, 3, 4, 5, 60]:
        text = " ".join(rnd.choice(["The", "ÉTÉ", "x\ty", "b  c", "z q"]) for _ in range(n))
        assert fingerprint(text.encode()) == brute_fingerprint(text)
    assert fingerprint(None) == fingerprint(b" \n") == 0


def test_radii_cover_every_split_of_the_distance():
    for n in (2, 3, 4, 5):
        parts = segments_of(n, 4)
        assert sum(w for _, w, _ in parts) == 64 and sum(r for _, _, r in parts) + n > 4


def documents(rnd):
    base = [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 3) for _ in range(150)) for _ in range(30)]
    rows = []
    for i in range(260):
        words = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, rows[0][1]), (903, rows[0][1]), (904, "w " * 300_000)]


def test_components_equal_brute_force_also_in_cut_buckets(spark):
    rows = documents(random.Random(5))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "no id", "x")], "doc_id long, text string, fp string")
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(fps)
    for kind in ({}, {"bucket_rows": 5}, {"segments": 3}):
        got = near_duplicates(df, **kind).collect()
        assert len(got) == len(rows) + 1
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None
            else:
                assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_pair_within_distance_meets(spark):
    rnd = random.Random(2)
    fps = [(rnd.getrandbits(64), 0)]
    for k in range(1, 40):
        x = fps[0][0]
        for b in rnd.sample(range(64), 4):
            x ^= 1 << b
        fps.append((x, k))
    to = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(to(a), k) for a, k in fps], "fp long, rep long")
    for n in (2, 3, 4, 5):
        e = entries(df, n, 4).toPandas()
        home = e[e.home].merge(e, on="key")
        assert set(home[home.rep_x == 0].rep_y) >= set(range(40))


def test_connected_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 160)] + [(200, 200), (160, 100), (160, 100)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain + star, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 161)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_ids_of_any_type(spark):
    rows = [("b", "one two three four five"), ("a", "one two three four five"), ("c", "other words"), (None, "other words")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", None: None}


def test_segments_follow_the_count():
    assert [segments_for(n) for n in (0, 4_000_000, 5_000_000, 10**8, 10**9)] == [4, 4, 3, 3, 2]
