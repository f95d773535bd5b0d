"""Piece lattices of short strings, evaluated for many strings at once.

A vocabulary's pieces are found by rolling hashes: for every length at once for
all strings of a length, so a lattice costs array operations only, for strings
of any length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))
_SLOT_BITS = 18


def read_vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, id) of the ordinary pieces of a SentencePiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [(model.id_to_piece(i), model.get_score(i), i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def codes_of(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)


class Lattice:
    """Finds pieces of ``pieces`` (unique, not empty). ``MISS`` = len(pieces)
    marks no piece, ``len(pieces) + 1`` a single code point outside them."""

    def __init__(self, pieces: list[str]):
        self.miss, self.unknown = len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        self.lengths = np.array([*map(len, pieces), 1, 1])
        self.hashes = np.zeros(len(pieces) + 2, np.uint64)
        by_length = defaultdict(list)
        for i, p in enumerate(pieces):
            by_length[len(p)].append(i)
        with np.errstate(over="ignore"):
            for n, ids in by_length.items():
                codes = codes_of([pieces[i] for i in ids]).reshape(-1, n).astype(np.uint64) + np.uint64(1)
                h = np.zeros(len(ids), np.uint64)
                for k in range(n):
                    h = h * _BASE + codes[:, k]
                self.hashes[ids] = h
            self.tables, left = [], np.arange(len(pieces))
            for mix in _MIX:
                slots = self.slots(self.hashes[left], mix)
                table = np.full(1 << _SLOT_BITS, self.miss, np.int32)
                table[slots[::-1]] = left[::-1]
                self.tables.append((mix, table))
                left = left[table[slots] != left]
                if not len(left):
                    break
        if len(left):
            raise ValueError("piece hashes collide")

    @staticmethod
    def slots(h: np.ndarray, mix: np.uint64) -> np.ndarray:
        return ((h * mix) >> np.uint64(64 - _SLOT_BITS)).astype(np.intp)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        found = None
        for mix, table in self.tables:
            ids = table[self.slots(h, mix)]
            ids[self.hashes[ids] != h] = self.miss
            found = ids if found is None else np.minimum(found, ids)
        return found

    def edges(self, codes: np.ndarray) -> list[np.ndarray]:
        """For strings of one length n, codes (count, n): element k has the piece
        of length k + 1 at each start, (count, n - k)."""
        n = codes.shape[1]
        c = codes.astype(np.uint64) + np.uint64(1)
        out, h = [], None
        with np.errstate(over="ignore"):
            for k in range(min(n, self.longest)):
                h = c if h is None else h[:, : n - k] * _BASE + c[:, k:]
                ids = self.look_up(h)
                if k == 0:
                    ids[ids == self.miss] = self.unknown
                out.append(ids)
        return out


def by_length(strings: list[str], most: int = 1 << 14, codes: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, codes) of strings of the same length, at most ``most`` at once, or one, and about ``codes`` code points."""
    groups = defaultdict(list)
    for i, s in enumerate(strings):
        groups[len(s)].append(i)
    for n, ids in groups.items():
        if n:
            many = max(1, min(most, codes // n))
            for at in range(0, len(ids), many):
                part = ids[at : at + many]
                yield np.array(part), codes_of([strings[i] for i in part]).reshape(-1, n)
