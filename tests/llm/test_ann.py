import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loomtext.llm import ann
from loomtext.llm.ann import Quantizer, Scan, nearest_neighbours, pack_codes


def brute(ids, x, query):
    d = np.sqrt(((x - x[query]) ** 2).sum(axis=1))
    order = [k for k in np.lexsort((ids, d)) if ids[k] != ids[query]][:10]
    return [(int(ids[k]), float(d[k])) for k in order]


def test_recall_against_brute_force(spark):
    for sf in ("sf0.01", "sf0.1"):
        path = f"/root/testdata/{sf}/embeddings.parquet"
        table = pq.read_table(path)
        ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), float)
        rows = nearest_neighbours(spark.read.parquet(path), F.col("id") % 100 == 0, query_block=9).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert set(got) == {int(i) for i in ids if i % 100 == 0}
        hits = 0
        for k, i in enumerate(ids):
            if i % 100 == 0:
                want = brute(ids, x, k)
                hits += len({v for v, _ in want} & {v for v, _ in got[i]})
                scores = dict(got[i])
                assert all(abs(scores[v] - s) < 1e-12 for v, s in want if v in scores) and len(got[i]) == 10
        assert hits >= 0.95 * 10 * len(got)


def test_recall_in_one_block_of_many_rows(monkeypatch):
    """The rerank is 0.2 % of a block here, and tables hold few queries at a time."""
    rnd = np.random.default_rng(11)
    centres = rnd.normal(size=(400, 32)) * 2
    x = centres[rnd.integers(0, 400, 100_000)] + rnd.normal(size=(100_000, 32))
    ids, own = np.arange(100_000), np.arange(0, 100_000, 2_500)
    quantizer = Quantizer.fit(x[:5000], rounds=3)
    packed = pack_codes(quantizer.codes(x))
    monkeypatch.setattr(ann, "TABLE_BYTES", 3 * len(quantizer.books) // 2 * 1024)
    scan = Scan(quantizer, own, x[own], 10, ann.RERANK)
    assert scan.each == 3
    hits = sum(len(set(found.tolist()) & {v for v, _ in brute(ids, x, q)}) for q, found, _ in scan.block(ids, x, packed))
    assert hits >= 0.9 * 10 * len(own)


def test_refit_lowers_the_anisotropic_loss():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(3000, 64)) @ rnd.normal(size=(64, 64)) + 3
    q = Quantizer.fit(x, rounds=3)
    codes = q.codes(x)
    before = q.loss(x, codes)
    q.refit(x, codes)
    assert q.loss(x, codes) <= before + 1e-9 and q.loss(x, q.codes(x)) <= before * 1.01
    plain = Quantizer(q.centre, q.books, 0.0).codes(x)
    assert q.loss(x, q.codes(x)) < q.loss(x, plain)


def test_copies_ties_and_odd_rows(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 3000)] + [(i, rnd.normal(size=3).tolist()) for i in range(3000, 3300)]
    rows += [(4000, None), (4100, [0.0, 0.0, 0.0]), (4200, [1.0, None, 2.0]), (4300, [float("nan"), 1.0, 1.0]), (4400, [1.0, float("inf"), 0.0]), (4500, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (3100, rows[3100][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, id int").drop("id")
    got = {}
    for r in nearest_neighbours(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 3300, 100))
    assert [got[0][k] for k in range(1, 11)] == [(k, 0.0) for k in range(1, 11)]
    assert [got[500][k][0] for k in range(1, 11)] == list(range(10))
    x = np.array([r[1] for r in rows[:3300]], np.float32).astype(float)
    ids = np.arange(3300)
    assert [got[3100][k][0] for k in range(1, 11)] == [v for v, _ in brute(ids, x, 3100)]
    few = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in nearest_neighbours(few, F.col("id") % 100 == 0).collect()] == [(100, 1)]
    assert nearest_neighbours(few.limit(0), F.col("id") % 100 == 0).count() == 0


def test_results_do_not_depend_on_partitions(spark):
    """100,000 rows in one partition and in ten: many blocks, of which each reranks a few per cent."""
    rnd = np.random.default_rng(12)
    centres = rnd.normal(size=(400, 16)) * 2
    x = centres[rnd.integers(0, 400, 100_000)] + rnd.normal(size=(100_000, 16))
    table = pa.table({"vec_id": np.arange(100_000), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 16).cast(pa.list_(pa.float64()))})
    df = spark.createDataFrame(table)
    got = []
    for n in (1, 10):
        rows = nearest_neighbours(df.repartition(n), F.col("id") % 2500 == 0).collect()
        got.append(sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows))
    assert got[0] == got[1] and len(got[0]) == 400
    hits = sum(len({v for q, _, v, _ in got[0] if q == i} & {v for v, _ in brute(np.arange(100_000), x, i)}) for i in range(0, 100_000, 2500))
    assert hits >= 0.9 * 400
