"""Target-distribution importance resampling over hashed word n-grams.

Pass one: every partition counts its features' buckets with ``np.bincount`` into
one vector; ``treeReduce`` adds the vectors, for the documents and for the target
texts. From both come the buckets' gains, ``floor(1000 * ln((t + 1) * (S +
buckets) / ((s + 1) * (T + buckets))))``. Pass two: the gains, as long as there
are buckets, are broadcast; each batch gathers them by bucket and sums them by
document with ``np.bincount``'s weights. A document's weight is the floored mean
of its gains and its score adds Gumbel noise drawn from a hash of its id, so the
highest scores are a sample without replacement, weighted by likelihood ratio.

Scores are stored; ranks come from a range partitioning by (score, id), counts of
its partitions and places within them, so nothing passes through one task. What
reaches the driver: two vectors and one count of each partition.

Defined results: a null or empty text has no features, weight 0 and no rank
(unless ``least_words`` is 0); equal rows have equal scores and successive ranks;
ties in score go to the smaller id, null last, then to fewer features; a null
id's noise comes from the text ``null``; no target texts, or no documents, count
as S or T of 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomtext.llm.rows import map_slices, slices
from loomtext.llm.shared import cut
from loomtext.llm.words import word_runs

BUCKETS, GRAMS, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
_IN_PARTITION = (1 << 33) - 1


def hashes(data: bytes | None, grams: int = GRAMS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, CRCs of the features that end in them) of each piece of a text: a
    feature's CRC goes on from that of the feature one word shorter."""
    before: list[bytes] = []
    for words in word_runs(data):
        run = before + words
        spaced = [b" " + w for w in run]
        level = list(map(crc32, run))
        out = [level[len(before) :]]
        for n in range(1, grams):
            level = list(map(crc32, spaced[n:], level))
            # features of n + 1 words that end in this piece
            out.append(level[max(0, len(before) - n) :])
        before = run[len(run) - min(len(run), grams - 1) :]
        yield len(words), np.array([c for part in out for c in part], np.int64)


def partition_counts(texts: DataFrame, text_col: str, buckets: int, grams: int) -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                for data in part.column(0).to_pylist():
                    for _, found in hashes(data, grams):
                        total += np.bincount(found % buckets, minlength=buckets)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    spark = texts.sparkSession
    vectors = texts.select(F.col(text_col).cast("binary")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    none = spark.sparkContext.parallelize([0], 1).map(lambda _: np.zeros(buckets, np.int64))
    return vectors.union(none).treeReduce(np.add)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * (s_all + n) / (float(s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(key: object, seed: int) -> int:
    """floor(1000 * Gumbel noise) of an id."""
    h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, grams: int, seed: int) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every document."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(gains.astype(np.float64)), len(gains)

    def make():
        def run(ids, texts):
            n_words, owners, found, held_back = [], [], [], 0
            sums, sizes = np.zeros(len(ids)), np.zeros(len(ids), np.int64)

            def flush():
                nonlocal held_back
                held_back = 0
                if found:
                    own = np.repeat(np.array(owners), [len(x) for x in found])
                    sums[:] += np.bincount(own, weights=held.value[np.concatenate(found) % buckets], minlength=len(ids))
                    sizes[:] += np.bincount(own, minlength=len(ids))
                    owners.clear(), found.clear()

            for i, data in enumerate(texts):
                words = 0
                for n, crcs in hashes(data, grams):
                    words += n
                    owners.append(i), found.append(crcs)
                    held_back += len(crcs)
                    if held_back > 1 << 20:
                        flush()
                n_words.append(words)
            flush()
            weights = [int(s) // n if n else 0 for s, n in zip(sums.tolist(), sizes.tolist())]
            return {id_col: ids, "n_words": n_words, "n_features": sizes.tolist(), "weight": weights, "score": [w + gumbel(k, seed) for w, k in zip(weights, ids)]}

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(id_col, F.col(text_col).cast("binary")), make, f"`{id_col}` {kind}, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, order: list, most: int) -> DataFrame:
    """``rows`` with ``rank`` from 1 in ``order``, null beyond ``most``: places in
    range partitions, moved on by the sizes of the partitions before."""
    spark = rows.sparkSession
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    offsets, before = [], 0
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, start long"))
    rank = F.col("start") + F.col("place").bitwiseAND(_IN_PARTITION) + 1
    return placed.withColumn("part", part).join(starts, "part").withColumn("rank", F.when(rank <= most, rank)).drop("part", "start", "place")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    buckets: int = BUCKETS, grams: int = GRAMS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; rank is null
    unless it is drawn. Of documents with ``least_words`` words, ``percent`` in a
    hundred are drawn."""
    gains = bucket_gains(partition_counts(docs, text_col, buckets, grams), partition_counts(target, target_col, buckets, grams))
    # the salt, fixed once stored, spreads rows that are equal in everything else
    rows = cut(scored(docs, gains, id_col, text_col, grams, seed).withColumn("salt", F.monotonically_increasing_id()))
    able = rows.where(F.col("n_words") >= least_words)
    drawn = ranked(able, [F.desc("score"), F.asc_nulls_last(id_col), F.asc("n_features"), F.asc("salt")], percent * able.count() // 100)
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(id_col, "n_features", "weight", "score", "rank")


def _s_words(table: str, key: str) -> str:
    return rf"""SELECT {key} AS k, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM {table}"""


def _s_grams(table: str) -> str:
    return f"""SELECT k, unnest(w) AS f FROM {table} UNION ALL SELECT k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {table}"""


def oracle_sql() -> str:
    """The same draw as DuckDB SQL; CRC-32 is a fold over a text's bytes by a table
    that the polynomial gives."""
    step = "(CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"""WITH RECURSIVE
crc AS (SELECT i, 0 AS n, i AS c FROM range(256) AS r(i) UNION ALL SELECT i, n + 1, {step} FROM crc WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE n = 8),
d AS ({_s_words("documents", "doc_id")}), b AS ({_s_words("benchmark", "item_id")}),
dg AS ({_s_grams("d")}), bg AS ({_s_grams("b")}),
texts AS (SELECT DISTINCT f FROM (SELECT f FROM dg UNION ALL SELECT f FROM bg)),
codes AS (SELECT f, list_transform(range(len(hex(encode(f))) // 2), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS x FROM texts),
buckets AS (SELECT f, xor(list_reduce(x, lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]), 4294967295), 4294967295) % {BUCKETS} AS k FROM codes, tab),
s AS (SELECT buckets.k, count(*) AS n FROM dg JOIN buckets USING (f) GROUP BY 1), t AS (SELECT buckets.k, count(*) AS n FROM bg JOIN buckets USING (f) GROUP BY 1),
sums AS (SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM s) AS s_all, (SELECT coalesce(sum(n), 0)::BIGINT FROM t) AS t_all),
gains AS (SELECT s.k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + {BUCKETS}) / ((s.n + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS g FROM s LEFT JOIN t USING (k), sums),
weights AS (SELECT dg.k AS doc_id, count(*) AS n, floor(sum(g) / count(*)::DOUBLE)::BIGINT AS weight FROM dg JOIN buckets USING (f) JOIN gains ON gains.k = buckets.k GROUP BY 1),
noise AS (SELECT k AS doc_id, len(w) AS words, ('0x' || substr(sha256('{SEED}:' || k), 1, 8))::BIGINT AS h FROM d),
scores AS (SELECT doc_id, words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM noise LEFT JOIN weights USING (doc_id)),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scores WHERE words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS rank FROM scores LEFT JOIN places USING (doc_id)"""
