"""Token counts by byte-pair merging, and texts cut to a budget of tokens.

A vocabulary is a table of byte strings and ranks; it is read once, on the
driver, from a file of lines ``base64 rank`` that the caller names, and broadcast: its
size is the vocabulary's. A text is split by a pattern; in each piece the adjacent
pair with the least rank is merged, the leftmost of equals, until none has one.
Pairs of a long piece wait in a queue, so n bytes take n log n steps however many they are;
those of a short one are a list. Counts of common short pieces are remembered by each task.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql.types import LongType, StringType, StructType

from loomtext.functions import text as T
from loomtext.functions.batches import row_udf

#: How public byte-level vocabularies split a text before merging; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED, SHORT, ROUNDS, AIM, SHRINK = 1 << 17, 64, 12, 0.95, 0.9
#: Longer texts are split piece by piece, not into a list.
LISTED = 1 << 20
_NONE = 1 << 62


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file, which any of Spark's file systems may hold."""
    rows = spark.read.text(path).where("trim(value) <> ''").collect()
    return {base64.b64decode(a): int(b) for a, b in (r.value.split() for r in rows)}


def merged_parts(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a piece. Single bytes that the vocabulary lacks stay as they are."""
    n = len(piece)
    if piece in ranks or n < 2:
        return [piece] if n else []
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(queue)
    alive = bytearray(b"\x01" * n)
    while queue:
        _, i, to = heappop(queue)
        j = after[i] if alive[i] else n
        if j >= n or not alive[i] or end[j] != to:
            continue  # one of the two has been merged since
        alive[j] = 0
        end[i], after[i] = to, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if b < n and (r := ranks.get(piece[a : end[b]])) is not None:
                heappush(queue, (r, a, end[b]))
    return [piece[i : end[i]] for i in range(n) if alive[i]]


def short_parts(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """``merged_parts`` of a piece of few bytes, without a queue."""
    if piece in ranks:
        return [piece]
    rank = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [rank(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != _NONE:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(parts[i] + parts[i + 1], _NONE)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + parts[i], _NONE)
    return parts


class Tokens:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.short = lru_cache(maxsize=REMEMBERED)(self.parts)

    def parts(self, piece: str) -> int:
        return len((short_parts if len(piece) <= SHORT else merged_parts)(piece.encode("utf-8", "replace"), self.ranks))

    def count(self, text: str) -> int:
        if len(text) <= LISTED and not self.split.groups:
            pieces = self.split.findall(text)
            if max(map(len, pieces), default=0) <= SHORT:
                return sum(map(self.short, pieces))
        return sum(self.short(p) if len(p) <= SHORT else self.parts(p) for p in (m[0] for m in self.split.finditer(text)))

    def fitted(self, text: str, most: int, count: int | None = None) -> str:
        """``text``, of ``count`` tokens if that is known, or its head and tail within ``most`` tokens: by
        proportion a little under the budget, then less in up to ``ROUNDS`` rounds while it is still over."""
        count = self.count(text) if count is None else count
        if count <= most:
            return text
        room = max(1, int(len(text) * (max(1, int(most * AIM)) / max(1, count))))
        out = head_and_tail(text, room)
        for _ in range(ROUNDS):
            if self.count(out) <= most:
                break
            room = max(1, int(room * SHRINK))
            out = head_and_tail(text, room)
        return out


def head_and_tail(text: str, most: int) -> str:
    """``text.clip_head_and_tail`` of one string, for budgets that differ by row."""
    if len(text) <= most:
        return text
    breaks = (". ", "! ", "? ")
    if most <= T.LEAST_SPLIT:
        head = text[:most]
        end = max(head.rfind(p) for p in (*breaks, "\n\n"))
        return head[: end + 1] if end > most * 0.5 else head
    room = most - len(T.OMISSION)
    first = room * 3 // 4
    rest = room - first
    head, tail = text[:first], text[len(text) - rest :]
    end = max(head.rfind(p) for p in (*breaks, "\n"))
    head = head[: end + 1] if end > first * 0.5 else head
    start = min((at for p in ("\n", *breaks) if (at := tail.find(p)) >= 0), default=rest)
    tail = tail[start + 1 :] if start < rest * 0.5 else tail
    return head.rstrip(T.BLANKS) + T.OMISSION + tail.lstrip(T.BLANKS)


class TokenColumns:
    """Columns over a vocabulary: ``count(text)``, ``fitted(text, most)`` and both from one
    count as a struct, ``counted(text, most)``; nulls stay null."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str = PATTERN):
        held = spark.sparkContext.broadcast((ranks, pattern))

        def count():
            own = Tokens(*held.value)
            return lambda t: None if t is None else own.count(t)

        def fitted():
            own = Tokens(*held.value)
            return lambda t, m: None if t is None or m is None else own.fitted(t, m)

        def counted():
            own = Tokens(*held.value)

            def both(t, m):
                n = None if t is None else own.count(t)
                return {"n": n, "cut": None if n is None or m is None else own.fitted(t, m, n)}

            return both

        self._count, self._fitted = row_udf(count, LongType()), row_udf(fitted, StringType())
        self._counted = row_udf(counted, StructType().add("n", "long").add("cut", "string"))

    def count(self, text: Column) -> Column:
        return self._count(text)

    def fitted(self, text: Column, most: Column) -> Column:
        return self._fitted(text, most.cast("long"))

    def counted(self, text: Column, most: Column) -> Column:
        return self._counted(text, most.cast("long"))
