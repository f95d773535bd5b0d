"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Nearness is Euclidean. With all vectors moved by a common centre, the nearest
vector to q maximises <q, x> - |x|^2 / 2, so the search is one for maximum inner
product with a bias that is kept exactly. Vectors are product-quantised, 16
codewords for each pair of dimensions, under the anisotropic loss: error along a
vector weighs more than error across it, by the weight that belongs to inner
products of over ``THRESHOLD`` of the norms. Codewords and codes are found by
turns, each in closed form. A scan adds up entries of a query's tables, one for
every byte of two four-bit codes; the best ``RERANK`` of a block of rows are
reranked by exact double-precision distances on the original vectors.

The codebooks are fitted on about ``SAMPLE`` rows, taken by a hash of the id;
every row is encoded. The index is a table of blocks of some ``BLOCK_BYTES``,
dealt by a hash of the id, so what is found does not depend on partitions or
batches. Queries go against all rows some ``QUERY_BYTES`` at a time, the only
thing broadcast; what they find is stored and their broadcast destroyed before
the next, so neither driver nor plan grows with the queries. A worker holds tables
of ``TABLE_BYTES`` at a time, for as many queries as they serve. Equal vectors in a block of rows count
once in the scan and are expanded to their smallest ids behind it, so thousands
of copies neither crowd out other vectors nor break ties wrongly.

Defined results: vectors that are null or zero, hold a null or a non-finite
component, or are of another length than most take no part, as query or
candidate, nor do null ids; an id given twice is its first vector (by value);
ties go to the smaller id; no usable rows give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtext.llm.shared import cut, shared_folder

NEIGHBOURS = 10
RERANK = 200
SAMPLE = 20_000
#: Bytes of queries that go over the index at once, and of vectors in one of its blocks.
QUERY_BYTES, BLOCK_BYTES = 32 << 20, 4 << 20
THRESHOLD = 0.2
CODEWORDS = 16
ROUNDS = 6
TABLE_BYTES = 64 << 20


@dataclass
class Quantizer:
    centre: np.ndarray
    books: np.ndarray
    """(subspaces, CODEWORDS, 2)"""
    extra: float
    """Weight of the error along a vector less that of the error across it, which is 1."""

    def split(self, x: np.ndarray) -> np.ndarray:
        """Centred vectors by subspace, (rows, subspaces, 2)."""
        out = np.zeros((len(x), len(self.books) * 2))
        out[:, : x.shape[1]] = x - self.centre
        return out.reshape(len(x), -1, 2)

    def directions(self, parts: np.ndarray) -> np.ndarray:
        norm = np.sqrt((parts**2).sum(axis=(1, 2), keepdims=True))
        return parts / np.where(norm > 0, norm, 1)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """(rows, subspaces), by coordinate descent from the nearest codewords."""
        parts = self.split(x)
        unit = self.directions(parts)
        codes = np.empty(parts.shape[:2], np.uint8)
        along = np.empty(parts.shape[:2])
        for m, book in enumerate(self.books):
            codes[:, m] = ((parts[:, m, None] - book) ** 2).sum(axis=2).argmin(axis=1)
            along[:, m] = ((parts[:, m] - book[codes[:, m]]) * unit[:, m]).sum(axis=1)
        total = along.sum(axis=1)
        for _ in range(sweeps):
            for m, book in enumerate(self.books):
                error = parts[:, m, None] - book
                each = (error * unit[:, m, None]).sum(axis=2)
                rest = total - along[:, m]
                loss = (error**2).sum(axis=2) + self.extra * (rest[:, None] + each) ** 2
                codes[:, m] = loss.argmin(axis=1)
                along[:, m] = each[np.arange(len(x)), codes[:, m]]
                total = rest + along[:, m]
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Codewords that minimise the loss for the codes, subspace by subspace."""
        parts = self.split(x)
        unit = self.directions(parts)
        along = np.stack([((parts[:, m] - b[codes[:, m]]) * unit[:, m]).sum(axis=1) for m, b in enumerate(self.books)], axis=1)
        total = along.sum(axis=1)
        for m in range(len(self.books)):
            u, v, rest = unit[:, m], parts[:, m], total - along[:, m]
            a = np.eye(2) + self.extra * u[:, :, None] * u[:, None, :]
            b = v + self.extra * u * (rest + (v * u).sum(axis=1))[:, None]
            for k in range(CODEWORDS):
                own = codes[:, m] == k
                if own.any():
                    self.books[m, k] = np.linalg.solve(a[own].sum(axis=0), b[own].sum(axis=0))
            along[:, m] = ((v - self.books[m][codes[:, m]]) * u).sum(axis=1)
            total = rest + along[:, m]

    def loss(self, x: np.ndarray, codes: np.ndarray) -> float:
        parts = self.split(x)
        error = parts - np.stack([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return float(((error**2).sum(axis=(1, 2)) + self.extra * (error * self.directions(parts)).sum(axis=(1, 2)) ** 2).mean())

    @classmethod
    def fit(cls, x: np.ndarray, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> Quantizer:
        d = x.shape[1]
        m = -(-d // 4) * 2  # an even number of subspaces, for whole bytes
        out = cls(x.mean(axis=0), np.zeros((m, CODEWORDS, 2)), 0.0)
        parts, rnd = out.split(x), np.random.default_rng(1)
        for k in range(m):
            pick = parts[rnd.choice(len(x), CODEWORDS, replace=len(x) < CODEWORDS), k]
            out.books[k] = pick + rnd.normal(0, 1e-6, pick.shape)
        for _ in range(rounds):  # plain quantisation first
            out.refit(x, out.codes(x, 0))
        out.extra = max(0.0, (d - 1) * threshold**2 / (1 - threshold**2) - 1)
        for _ in range(rounds):
            out.refit(x, out.codes(x))
        return out


def pack_codes(codes: np.ndarray) -> np.ndarray:
    return codes[:, 0::2] | codes[:, 1::2] << 4


class Scan:
    """Queries (ids, vectors) against blocks of encoded rows."""

    def __init__(self, quantizer: Quantizer, ids: np.ndarray, x: np.ndarray, neighbours: int, rerank: int):
        self.ids, self.x, self.neighbours, self.rerank = ids, x, neighbours, rerank
        self.quantizer, self.centre = quantizer, quantizer.centre
        self.each = max(1, TABLE_BYTES // (len(quantizer.books) // 2 * 256 * 4))
        self.held: tuple[int, np.ndarray] | None = None

    def tables(self, start: int) -> np.ndarray:
        """Of the queries from ``start`` on; the last ones made are kept, so a block
        of queries that fits is tabled once for all rows of a task."""
        if self.held is None or self.held[0] != start:
            parts = self.quantizer.split(self.x[start : start + self.each])
            tables = np.einsum("qms,mks->qmk", parts, self.quantizer.books).astype(np.float32)
            # a byte's entry: its low code's and its high code's
            self.held = start, (tables[:, 0::2, None, :] + tables[:, 1::2, :, None]).reshape(len(parts), -1, 256)
        return self.held[1]

    def block(self, ids: np.ndarray, x: np.ndarray, packed: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, distances) of each query's nearest in a block."""
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x, packed = ids[order], x[order], packed[order]
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)])
        copies = np.diff(np.r_[first, len(ids)])
        distinct, columns = x[first], np.ascontiguousarray(packed[first].T)
        bias = (0.5 * ((distinct - self.centre) ** 2).sum(axis=1)).astype(np.float32)
        for q in range(len(self.ids)):
            table, score = self.tables(q - q % self.each)[q % self.each], -bias
            for b, column in enumerate(columns):
                score += table[b].take(column)
            near = np.arange(len(first)) if len(first) <= self.rerank else np.argpartition(-score, self.rerank - 1)[: self.rerank]
            distance = np.sqrt(((distinct[near] - self.x[q]) ** 2).sum(axis=1))
            # the smallest ids of each vector, one more than asked for as one may be the query's own
            many = np.minimum(copies[near], self.neighbours + 1)
            at = np.arange(int(many.sum())) + np.repeat(first[near] - np.cumsum(many) + many, many)
            found, distance = ids[at], np.repeat(distance, many)
            other = found != self.ids[q]
            found, distance = found[other], distance[other]
            best = np.lexsort((found, distance))[: self.neighbours]
            yield int(self.ids[q]), found[best], distance[best]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): one row for each id, without the vectors that take no part."""
    x = F.col(vector_col).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & (F.size("x") > 0) & good)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (sizes[0]["d"] if sizes else 0)).groupBy("id").agg(F.min("x").alias("x"))


def build_index(rows: DataFrame, sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Quantizer | None]:
    """(ids, x, codes) of blocks of the ``rows`` (id, x), packed as bytes, and the
    quantizer fitted on the sample. Blocks hold some ``block_bytes`` of vectors,
    dealt by a hash of the id, so they are the same however rows lie in partitions."""
    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "ids binary, x binary, codes binary"), None
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.where(draw < min(1.0, sample / total)).orderBy("id").limit(2 * sample).select("x").toArrow() if total > sample else rows.orderBy("id").select("x").toArrow()
    fitted = np.array(drawn.column(0).to_pylist(), float)
    quantizer = Quantizer.fit(fitted)
    blocks = max(1, -(-total * 8 * fitted.shape[1] // block_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(kept).combine_chunks()
            kept.clear()
            x = matrix(table.column(2).chunk(0))
            parts = (table.column(1).to_numpy().astype(np.int64), x, pack_codes(quantizer.codes(x)))
            return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], names=["ids", "x", "codes"])

        for batch in batches:
            own = batch.column(0).to_numpy()
            edges = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)] if len(own) else []
            for at, end in zip(edges[:-1], edges[1:]):
                if kept and kept[0].column(0)[0].as_py() != own[at]:
                    yield packed()
                kept.append(batch.slice(at, end - at))
        if kept:
            yield packed()

    block = F.pmod(F.xxhash64(F.lit("dealt"), "id"), F.lit(blocks)).alias("block")
    dealt = rows.select(block, "id", "x").repartition("block").sortWithinPartitions("block", "id")
    return dealt.mapInArrow(encode, "ids binary, x binary, codes binary"), quantizer


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(index: DataFrame, quantizer: Quantizer, queries: DataFrame, neighbours: int = NEIGHBOURS, rerank: int = RERANK, query_block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the ``queries`` (id, x), some QUERY_BYTES
    of which, or ``query_block``, go over the index at once."""
    spark, width = index.sparkSession, len(quantizer.centre)
    blocks = max(1, -(-queries.count() // (query_block or max(1, QUERY_BYTES // (8 * width)))))
    kind, folder = "query_id long, vec_id long, score double", f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    spark.createDataFrame([], kind).write.parquet(folder)
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)) == b).orderBy("id").select("id", "x").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        sent = spark.sparkContext.broadcast((own.column(0).to_numpy(), np.array(own.column(1).to_pylist(), float)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scan = None
            for batch in batches:
                for ids, x, codes in zip(*(c.to_pylist() for c in batch.columns)):
                    scan = scan or Scan(quantizer, *sent.value, neighbours, rerank)
                    ids = np.frombuffer(ids, np.int64)
                    parts = list(scan.block(ids, np.frombuffer(x, float).reshape(len(ids), -1), np.frombuffer(codes, np.uint8).reshape(len(ids), -1)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in parts], [len(i) for _, i, _ in parts]).astype(np.int64)), pa.array(np.concatenate([i for _, i, _ in parts])), pa.array(np.concatenate([d for _, _, d in parts]))], names=["query_id", "vec_id", "score"])

        index.mapInArrow(run, kind).write.mode("append").parquet(folder)
        sent.destroy()
    found = spark.read.schema(kind).parquet(folder)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = NEIGHBOURS, rerank: int = RERANK, query_block: int | None = None) -> DataFrame:
    """Each query's nearest rows; ``is_query`` is a test of the column ``id``."""
    rows = cut(usable(vectors, id_col, vector_col))
    index, quantizer = build_index(rows)
    if quantizer is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(cut(index), quantizer, rows.where(is_query), neighbours, rerank, query_block)
