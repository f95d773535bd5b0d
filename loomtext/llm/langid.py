"""Language identification by unigrams summed over all segmentations.

Pieces of a fixed public vocabulary get a probability in every language. A
word's likelihood is the sum over all its segmentations into pieces, by the
forward algorithm; a text's log-likelihood is the sum over its words, and the
score is the posterior of the best language under equal priors. Probabilities
are learned by expectation-maximisation over the same lattices from labelled
rows: about ``TRAIN_DOCS`` rows of each language, taken by a hash of the id,
whose crc32 mod ``FOLDS`` is not 0. That sample is the only bound; every text
is scored whole.

Defined results: a null text or one without a letter gives ``und`` with score
0, as does every text if nothing was learned; ties go to the language that
sorts first; equal texts get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomtext.llm.lattice import SPACE, Lattice, by_length, read_vocabulary
from loomtext.llm.rows import map_slices, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS = 5
TRAIN_DOCS = 1000
ROUNDS = 3
#: The sample's words, bounded by TRAIN_DOCS, lie in so many partitions.
WORD_PARTS = 12
#: Added to each piece's expected count; probability of a code point outside the vocabulary.
PRIOR, UNKNOWN = 0.1, 1e-7
#: Probabilities are carried times SCALE for each code point, and sums are brought
#: back to 1 every RESCALE code points, so that a word of any length does not underflow.
SCALE = 200.0
RESCALE = 32
CACHE_WORDS = 400_000


@dataclass
class LanguageModel:
    langs: list[str]
    pieces: list[str]
    weights: np.ndarray
    """(pieces + 2, languages): probability times SCALE ** length; the last two
    rows are no piece and a code point outside the vocabulary."""

    @classmethod
    def of(cls, langs: list[str], pieces: list[str], counts: np.ndarray) -> LanguageModel:
        p = (counts + PRIOR) / (counts.sum(axis=0) + PRIOR * len(pieces))
        scale = SCALE ** np.array([len(x) for x in pieces], float)[:, None]
        n = len(langs)
        return cls(langs, pieces, np.concatenate([p * scale, np.zeros((1, n)), np.full((1, n), UNKNOWN * SCALE)]))


def forward(edges: list[np.ndarray], weights: np.ndarray, n: int, last_only: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """alpha[j]: (strings, languages), the sum over segmentations of the first j code
    points, and logs[j]: the logarithm of what alpha[j] was divided by, as a factor of
    every alpha of the same or a later stretch of RESCALE code points."""
    shape = edges[0].shape[0], weights.shape[1]
    alpha, logs, near = [np.ones(shape)], [np.zeros(shape)], [np.ones(shape)]
    for j in range(1, n + 1):
        total = near[-1] * weights[edges[0][:, j - 1]]
        for k in range(1, min(j, len(edges))):
            total += near[-1 - k] * weights[edges[k][:, j - 1 - k]]
        log = logs[-1]
        near = [*near[-len(edges) + 1 :], total] if len(edges) > 1 else [total]
        if j % RESCALE == 0:
            log = log + np.log(total)
            near = [x / total for x in near]
        if last_only:
            alpha, logs = [], []
        alpha.append(near[-1])
        logs.append(log)
    return alpha, logs


def word_scores(lattice: Lattice, weights: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-likelihoods (words, languages)."""
    out = np.zeros((len(words), weights.shape[1]))
    for at, codes in by_length([SPACE + w for w in words]):
        n = codes.shape[1]
        alpha, logs = forward(lattice.edges(codes), weights, n, last_only=True)
        out[at] = np.log(alpha[-1]) + logs[-1] - n * np.log(SCALE)
    return out


def expected_counts(lattice: Lattice, weights: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (pieces + 2, languages); counts (words, languages)."""
    out = np.zeros_like(weights)
    for at, codes in by_length([SPACE + w for w in words]):
        n, edges = codes.shape[1], lattice.edges(codes)
        alpha, logs = forward(edges, weights, n)
        # beta by the same sums from the end, over the reversed lattice
        back = [np.ascontiguousarray(e[:, ::-1]) for e in edges]
        beta, behind = forward(back, weights, n)
        whole = np.log(alpha[n]) + logs[n]
        for k, ids in enumerate(edges):
            for i in range(n - k):
                here = ids[:, i]
                used = np.flatnonzero(here != lattice.miss)
                if len(used):
                    here, rest = here[used], n - i - k - 1
                    factor = np.exp(logs[i][used] + behind[rest][used] - whole[used]) if n >= RESCALE else 1 / alpha[n][used]
                    value = counts[at[used]] * factor * alpha[i][used] * weights[here] * beta[rest][used]
                    for lang in range(out.shape[1]):
                        out[:, lang] += np.bincount(here, value[:, lang], len(out))
    return out


def fold_of(id_col: str, folds: int = FOLDS) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS, folds: int = FOLDS) -> LanguageModel:
    """What comes to the driver is bounded by the vocabulary times the languages."""
    pieces = [p for p, _, _ in read_vocabulary(vocabulary) if SPACE not in p[1:]]
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (fold_of(id_col, folds) != 0))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 2, 0)))
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1.0, train_docs / sizes[lang]))))
    draw = F.pmod(F.xxhash64(F.lit("train"), id_col), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < share[F.col(lang_col)]).select(lang_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found: Counter = Counter()
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found.update((lang, w) for w in text.split())
                keys = list(found)
                yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in keys], "word": [k[1] for k in keys], "n": list(found.values())})

    words = sample.mapInArrow(count, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    words = words.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n"))
    words = words.select("word", F.array(*(F.coalesce(F.col("n")[lang], F.lit(0)).cast("double") for lang in langs)).alias("n")).coalesce(WORD_PARTS).persist()
    sc = docs.sparkSession.sparkContext
    counts = np.ones((len(pieces), len(langs)))
    for _ in range(rounds):
        sent = sc.broadcast(LanguageModel.of(langs, pieces, counts))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model = sent.value
            lattice, total = Lattice(model.pieces), np.zeros_like(model.weights)
            for batch in batches:
                if batch.num_rows:
                    total += expected_counts(lattice, model.weights, batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), float))
            used = np.flatnonzero(total.sum(axis=1))
            yield pa.RecordBatch.from_pydict({"piece": used.astype(np.int32)} | {f"n{k}": total[used, k] for k in range(len(model.langs))})

        schema = "piece int, " + ", ".join(f"n{k} double" for k in range(len(langs)))
        sums = words.mapInArrow(expect, schema).groupBy("piece").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(langs)))).toPandas()
        sent.destroy()
        counts = np.zeros((len(pieces) + 2, len(langs)))
        counts[sums["piece"]] = sums[[f"n{k}" for k in range(len(langs))]]
        counts = counts[: len(pieces)]
    words.unpersist()
    return LanguageModel.of(langs, pieces, counts)


class Scorer:
    """Scores texts; word scores are kept for up to CACHE_WORDS words at a time."""

    def __init__(self, model: LanguageModel):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs)))

    def rows(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.known]
        if new and len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.scores = {}, self.scores[:0]
            new = list(set(words))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.scores = np.concatenate([self.scores, word_scores(self.lattice, self.model.weights, new)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores, split = ["und"] * len(texts), [0.0] * len(texts), {}
        if self.model.langs:
            split = {i: t.split() for i, t in enumerate(texts) if t and any(map(str.isalpha, t))}
        if split:
            ids = self.rows([w for words in split.values() for w in words])
            starts = np.cumsum([0, *map(len, split.values())])[:-1]
            total = np.add.reduceat(self.scores[ids], starts)
            p = np.exp(total - total.max(axis=1, keepdims=True))
            best = p.argmax(axis=1)
            p = (p.max(axis=1) / p.sum(axis=1)).tolist()
            for k, i in enumerate(split):
                langs[i], scores[i] = self.model.langs[best[k]], p[k]
        return langs, scores


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with two columns more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def make():
        scorer = Scorer(sent.value)

        def run(*columns):
            langs, scores = scorer.predict(columns[at])
            return dict(zip(names, columns)) | {lang_out: langs, score_out: scores}

        return run

    schema = docs.select("*", F.lit("").alias(lang_out), F.lit(0.0).alias(score_out)).schema
    return map_slices(docs, make, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; a null id is not held out
    and not learned from."""
    model = fit(docs, id_col, text_col, lang_col, vocabulary, train_docs)
    rows = docs.select(id_col, F.coalesce(fold_of(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text_"))
    return identify(rows, model, "text_").drop("text_")
