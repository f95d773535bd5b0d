"""SentencePiece encoding and decoding with exact N-best segmentations.

A text, with a mark before it and for each space, is a lattice of the pieces of
a public SentencePiece vocabulary; a path's score is the sum of its pieces'
scores. No piece holds a mark behind another character, so the lattice falls
apart into chunks (marks and the characters up to the next mark), and a text's
best paths are made of its chunks' best paths. For a chunk, forward Viterbi
scores give the best path and are the exact heuristics of a backward A-star
search that yields its paths in order of score. A text's N best differ from its
best one only in the N - 1 chunks whose second path costs least (the gap comes
from forward and backward scores of the edges off the best path), so only those
are searched. Code points outside the vocabulary, and the mark itself in a text,
become byte pieces, so decoding gives back every text exactly.

The public vocabulary is a byte-pair model, whose scores are the order of its
merges, not log-probabilities. The paths here are the best by the sum of these
scores, as a unigram model would take them; they are not what the library's
``encode`` returns for that model, which applies the merges one by one, and have
some 14 % more pieces.

Defined results: a null text gives null ids, no pieces and no paths; an empty
text has one empty path of score 0; paths of equal score come in the order of
the search, which depends on the text alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache
from itertools import product
from math import prod

import numpy as np
from pyspark.sql import DataFrame

from loomtext.llm.lattice import SPACE, Lattice, by_length, read_vocabulary
from loomtext.llm.rows import map_slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
#: Under the lowest score of the vocabulary, for a code point outside it.
UNKNOWN_UNDER = 10.0
CACHE_CHUNKS = 600_000
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(maxsize=4096)
def combinations(sizes: tuple[int, ...], n: int) -> list[tuple[int, ...]]:
    """Choices of one path of each list that can be among the n best: those that
    fewer than n choices are at least as good as in every list."""
    return [p for p in product(*map(range, sizes)) if prod(k + 1 for k in p) <= n]


class Codec:
    def __init__(self, vocabulary: str = VOCABULARY):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        rows = [r for r in read_vocabulary(vocabulary) if SPACE not in r[0].lstrip(SPACE)]
        self.pieces, self.ids = [r[0] for r in rows], np.array([r[2] for r in rows], np.int32)
        self.bytes_ = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
        scores = [r[1] for r in rows]
        self.scores = np.array([*scores, -np.inf, min(scores) - UNKNOWN_UNDER])
        self.lattice = Lattice(self.pieces)
        self.index = {p: k for k, p in enumerate(self.pieces)}
        self.longest = self.lattice.longest
        self.raw: dict[int, bytes] = {i: p.replace(SPACE, " ").encode() for p, _, i in rows} | {i: bytes([b]) for b, i in self.bytes_.items()}
        self.clear()

    def clear(self) -> None:
        """Empties the cache of chunks: best ids (flat, by offset), score and gap to the second path."""
        self.known: dict[str, int] = {}
        self.flat, self.offset = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.best, self.gap = np.zeros(0), np.zeros(0)
        self.paths: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}

    # one chunk

    def byte_ids(self, char: str) -> list[int]:
        return [self.bytes_[b] for b in char.encode("utf-8", "surrogatepass")]

    def edges_to(self, s: str, j: int) -> list[tuple[int, float, int]]:
        """(start, score, piece or -1) of the edges that end at j, shortest first."""
        out = []
        for i in range(j - 1, max(-1, j - self.longest - 1), -1):
            k = self.index.get(s[i:j])
            if k is not None:
                out.append((i, float(self.scores[k]), k))
            elif i == j - 1:
                out.append((i, float(self.scores[-1]), -1))
        return out

    def nbest(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths (score, ids) of a chunk, by backward A-star."""
        edges = [[]] + [self.edges_to(s, j) for j in range(1, len(s) + 1)]
        forward = [0.0]
        for j in range(1, len(s) + 1):
            forward.append(max(forward[i] + score for i, score, _ in edges[j]))
        heap, count, out = [(-forward[len(s)], 0, len(s), 0.0, None)], 1, []
        while heap and len(out) < n:
            _, _, j, behind, path = heapq.heappop(heap)
            if j == 0:
                ids = []
                while path:
                    (i, piece), path = path
                    ids += [int(self.ids[piece])] if piece >= 0 else self.byte_ids(s[i])
                out.append((behind, ids))
                continue
            for i, score, piece in edges[j]:
                heapq.heappush(heap, (-(forward[i] + score + behind), count, i, behind + score, ((i, piece), path)))
                count += 1
        return out

    # many chunks

    def add(self, chunks: list[str]) -> None:
        """Best path and gap of new chunks, all chunks of a length at once."""
        best, gap = np.zeros(len(chunks)), np.zeros(len(chunks))
        owners, places, found = [], [], []  # of the pieces on the best paths
        for at, codes in by_length(chunks):
            w, n = codes.shape
            edges = self.lattice.edges(codes)
            score = [self.scores[e] for e in edges]
            fwd = np.full((n + 1, w), -np.inf)
            fwd[0] = 0
            back = np.zeros((n + 1, w), np.int64)
            for j in range(1, n + 1):
                options = np.stack([fwd[j - 1 - k] + score[k][:, j - 1 - k] for k in range(min(j, len(edges)))])
                back[j] = options.argmax(axis=0)
                fwd[j] = options.max(axis=0)
            bwd = np.full((n + 1, w), -np.inf)
            bwd[n] = 0
            for i in range(n - 1, -1, -1):
                bwd[i] = np.max([bwd[i + k + 1] + score[k][:, i] for k in range(min(len(edges), n - i))], axis=0)
            on = [np.zeros(e.shape, bool) for e in edges]
            place, steps, open_ = np.full(w, n), [], np.arange(w)
            while len(open_):
                k = back[place[open_], open_]
                start = place[open_] - 1 - k
                for length in np.unique(k):
                    these = k == length
                    on[length][open_[these], start[these]] = True
                steps.append((open_, start, k))
                place[open_] = start
                open_ = open_[start > 0]
            second = np.full(w, -np.inf)
            for k in range(len(edges)):
                through = fwd[: n - k].T + score[k] + bwd[k + 1 :].T
                through[on[k]] = -np.inf
                second = np.maximum(second, through.max(axis=1))
            for rows, start, k in steps:
                pieces = np.empty(len(rows), np.int64)
                for length in np.unique(k):
                    these = k == length
                    pieces[these] = edges[length][rows[these], start[these]]
                known = pieces != self.lattice.unknown
                owners.append(at[rows[known]])
                places.append(start[known] * 4)
                found.append(self.ids[pieces[known]])
                for r, i in zip(rows[~known].tolist(), start[~known].tolist()):
                    raw = self.byte_ids(chunks[at[r]][i])
                    owners.append(np.full(len(raw), at[r]))
                    places.append(i * 4 + np.arange(len(raw)))
                    found.append(np.array(raw, np.int32))
            best[at], gap[at] = fwd[n], fwd[n] - second
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        owner = np.concatenate([np.zeros(0, np.int64), *owners])
        order = np.lexsort((np.concatenate([np.zeros(0, np.int64), *places]), owner))
        self.flat = np.concatenate([self.flat, np.concatenate([np.zeros(0, np.int32), *found])[order]])
        self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum(np.bincount(owner, minlength=len(chunks)))])
        self.best, self.gap = np.concatenate([self.best, best]), np.concatenate([self.gap, gap])

    # texts

    def chunks_of(self, text: str) -> list[str]:
        """Chunks in order; a mark in the text itself is a chunk of its own, named by a line feed before it."""
        if not text:
            return []
        if SPACE not in text:
            return _CHUNK.findall(SPACE + text.replace(" ", SPACE))
        out = []
        for k, part in enumerate(text.split(SPACE)):
            part = part.replace(" ", SPACE)
            out += ["\n" + SPACE] * (k > 0) + _CHUNK.findall(SPACE + part if k == 0 else part)
        return out

    def ensure(self, chunks: list[list[str]]) -> None:
        wanted = {c for row in chunks for c in row}
        new = [c for c in wanted if c not in self.known]
        if len(self.known) + len(new) > CACHE_CHUNKS and self.known:
            self.clear()
            new = list(wanted)
        if new:
            marks = [c for c in new if c == "\n" + SPACE]
            self.add(sorted(c for c in new if c != "\n" + SPACE))
            for c in marks:
                self.known[c] = len(self.known)
                self.flat = np.concatenate([self.flat, np.array(self.byte_ids(SPACE), np.int32)])
                self.offset = np.append(self.offset, self.offset[-1] + 3)
                self.best, self.gap = np.append(self.best, self.scores[-1]), np.append(self.gap, np.inf)

    def gather(self, rows: np.ndarray) -> np.ndarray:
        start, size = self.offset[rows], self.offset[rows + 1] - self.offset[rows]
        shift = np.repeat(start - np.cumsum(size) + size, size)
        return self.flat[np.arange(len(shift)) + shift]

    def encode(self, texts: list[str | None], n: int = NBEST) -> list[list[tuple[float, np.ndarray]] | None]:
        """The n best (score, ids) of each text, best first; None for None."""
        split = [self.chunks_of(t) if t else [] for t in texts]
        self.ensure(split)
        out = []
        for text, chunks in zip(texts, split):
            if text is None:
                out.append(None)
                continue
            rows = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
            ids, score = self.gather(rows), float(self.best[rows].sum())
            found = [(score, ids)]
            gaps = self.gap[rows]
            near = np.flatnonzero(np.isfinite(gaps))
            if n > 1 and len(near):
                if len(near) > n - 1:
                    edge = np.partition(gaps[near], n - 2)[n - 2]
                    under, same = near[gaps[near] < edge], near[gaps[near] == edge]
                    near = np.sort(np.concatenate([under, same[: n - 1 - len(under)]]))
                ends = np.cumsum(self.offset[rows + 1] - self.offset[rows])
                options = []
                for at in near.tolist():
                    key = (chunks[at], n)
                    if key not in self.paths:
                        self.paths[key] = self.nbest(*key)
                    options.append(self.paths[key])
                lost_by = [[o[0][0] - x[0] for x in o] for o in options]
                picks = [(sum(x[k] for x, k in zip(lost_by, p)), p) for p in combinations(tuple(map(len, options)), n)]
                for _, pick in sorted(picks)[1:n]:
                    parts, done, lost = [], 0, 0.0
                    for at, o, k in zip(near.tolist(), options, pick):
                        if k:
                            size = int(self.offset[rows[at] + 1] - self.offset[rows[at]])
                            parts += [ids[done : ends[at] - size], np.array(o[k][1], np.int32)]
                            done, lost = int(ends[at]), lost + o[k][0] - o[0][0]
                    found.append((score + lost, np.concatenate([*parts, ids[done:]])))
            out.append(found)
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids array<int>): the best path of every text."""

    def make():
        codec = Codec(vocabulary)
        return lambda keys, texts: {id_col: keys, "ids": [found and found[0][1] for found in codec.encode(texts, 1)]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, ids array<int>")


def decode_column(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text): the text of every array of ids, null for null."""

    def make():
        codec = Codec(vocabulary)
        return lambda keys, ids: {id_col: keys, "text": [None if x is None else codec.decode(x) for x in ids]}

    kind = rows.schema[id_col].dataType.simpleString()
    return map_slices(rows.select(id_col, ids_col), make, f"`{id_col}` {kind}, text string")


def nbest_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NBEST, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_pieces, ids_sha256, score, nbest, round_trip) of every row: nbest has
    score, pieces and digest of the n best paths, digests being of little-endian
    32-bit ids; round_trip tells whether the best decodes to the text."""

    def make():
        codec = Codec(vocabulary)

        def run(keys, texts):
            cols = {c: [] for c in (id_col, "n_pieces", "ids_sha256", "score", "nbest", "round_trip")}
            for key, text, found in zip(keys, texts, codec.encode(texts, n)):
                paths = [{"score": s, "n_pieces": len(ids), "ids_sha256": _digest(ids)} for s, ids in found or []]
                row = (key, paths[0]["n_pieces"], paths[0]["ids_sha256"], paths[0]["score"]) if paths else (key, 0, None, None)
                back = codec.decode(found[0][1]) == text if found else None
                for name, value in zip(cols, (*row, paths, back)):
                    cols[name].append(value)
            return cols

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_pieces int, ids_sha256 string, score double, nbest array<struct<score:double,n_pieces:int,ids_sha256:string>>, round_trip boolean"
    return map_slices(docs.select(id_col, text_col), make, schema)
