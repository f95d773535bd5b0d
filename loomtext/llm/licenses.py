"""Licence scan: ordered signature rules behind a keyword gate.

A text's folded words, joined by single blanks, are matched by the hand-written
rules of ``license_rules``. A rule runs only on a piece of text that has its
keyword: its longest plain word, or one of each choice where it has none. A rule matches at any word where it can begin.
Overlapping detections are settled by priority, then length, then first place,
then the rules' order: one that lies within the interval of a detection kept
before it goes. Base phrases are found in the same way, under a kind of their own, and
nothing suppresses them. A detection's certainty follows its kind; a text's score
is the highest certainty of its base phrases and detections.

Texts are read in pieces of ``PIECE`` bytes, each with the next ``REACH`` words, and
no rule is longer; so a detection does not depend on where pieces end. Memory
follows a piece and the detections, and no row depends on another, so there is
no shuffle.

Defined results: a null or empty text has no words and no labels, null first
and last words and score 0; equal texts give equal results; rows repeat as they
are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from loomtext.llm.license_rules import RULES
from loomtext.llm.rows import map_slices
from loomtext.llm.words import PIECE, word_runs

#: Fixed phrases and labels of the base.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Certainty by kind, in order of priority.
CERTAINTY = {"base": 0.8, "text": 1.0, "grant": 0.95, "tag": 1.0, "link": 0.9, "name": 0.7}
KINDS = tuple(CERTAINTY)
#: Words that a rule can span at most.
REACH = 128


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    keywords: frozenset[bytes]
    match: re.Pattern


_GROUP = re.compile(r"\(((?:[^()]|\([^()]*\)\??)*)\)(\??)")


def longest_word(pattern: str) -> str:
    plain = [w for w in _GROUP.sub(" ", pattern).split() if re.fullmatch("[a-z0-9]*[a-z][a-z0-9]*", w)]
    return max(plain, key=len, default="")


def keywords(pattern: str) -> set[str]:
    """Words of which every match has one: the longest plain word, else the longest
    of each choice of a group that must be there."""
    found = longest_word(pattern)
    if found:
        return {found}
    choices = [{longest_word(c) for c in m[1].split("|")} for m in _GROUP.finditer(pattern) if not m[2]]
    return next(c for c in choices if all(c))


def rule(label: str, kind: str, pattern: str) -> Rule:
    parts = re.split(r" ~(\d+) ", pattern)
    body = parts[0] + "".join(f"(?: [^ ]+){{0,{parts[i]}}}? {parts[i + 1]}" for i in range(1, len(parts), 2))
    return Rule(label, kind, frozenset(w.encode() for w in keywords(pattern)), re.compile(f"(?= ({body}) )".encode()))


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    lines = [line.split(" ", 2) for line in RULES.strip().splitlines()]
    return tuple([rule(label, "base", phrase) for phrase, label in BASE.items()] + [rule(*line) for line in lines])


class Scanner:
    def __init__(self, own: tuple[Rule, ...]):
        self.own, self.by_keyword = own, defaultdict(list)
        for k, r in enumerate(own):
            for word in r.keywords:
                self.by_keyword[word].append(k)
        self.keywords = frozenset(self.by_keyword)

    def piece(self, words: list[bytes], ahead: list[bytes], at: int) -> list[tuple[int, int, int]]:
        """(first word, word behind the last, rule) of what begins in ``words``,
        the first of which is word ``at`` of the text."""
        gate = self.keywords.intersection(words).union(self.keywords.intersection(ahead))
        if not gate:
            return []
        text = b" " + b" ".join(words) + b" "
        limit = len(text) - 1
        text += b" ".join(ahead) + b" "
        starts: list[tuple[int, int, int]] = []
        out = []
        for k in {k for word in gate for k in self.by_keyword[word]}:
            starts += [(m.start(), m.end(1), k) for m in self.own[k].match.finditer(text) if m.start() < limit]
        starts.sort()
        done = count = 0
        for a, b, k in starts:
            count += text.count(b" ", done, a)
            done = a
            first = at + count
            out.append((first, first + 1 + text.count(b" ", a + 1, b), k))
        return out

    def detections(self, data: bytes | None, size: int = PIECE) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words and all matches of all rules."""
        found, at, words = [], 0, []
        for run in word_runs(data, size):
            # a piece waits until enough words lie behind it
            words += run
            if len(words) > REACH + (size >> 4):
                found += self.piece(words[:-REACH], words[-REACH:], at)
                at, words = at + len(words) - REACH, words[-REACH:]
        found += self.piece(words, [], at) if words else []
        return at + len(words), found

    def kept(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Base phrases, and the detections that no better one contains."""
        own, out, free = self.own, [], []
        starts: list[int] = []
        ends: dict[int, int] = {}
        for x in found:
            (out if own[x[2]].kind == "base" else free).append(x)
        for a, b, k in sorted(set(free), key=lambda x: (KINDS.index(own[x[2]].kind), x[0] - x[1], x[0], x[2])):
            at = bisect_right(starts, a) - 1
            if at >= 0 and ends[starts[at]] >= b:
                continue
            out.append((a, b, k))
            # intervals that contain one another need only the outer one
            to = bisect_left(starts, a)
            while to < len(starts) and ends[starts[to]] <= b:
                del ends[starts.pop(to)]
            insort(starts, a)
            ends[a] = b
        return sorted(out)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(rules())


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word (of base
    phrases), base_labels, labels, score, and detections (label:first:end)."""

    def make():
        scan = scanner()
        own = scan.own

        def run(ids, texts):
            cols = defaultdict(list)
            cols[id_col] = ids
            for data in texts:
                n, found = scan.detections(data)
                kept = scan.kept(found)
                base = [a for a, _, k in kept if own[k].kind == "base"]
                cols["n_words"].append(n)
                cols["n_base"].append(len(base))
                cols["first_word"].append(min(base, default=None))
                cols["last_word"].append(max(base, default=None))
                cols["base_labels"].append(",".join(sorted({own[k].label for _, _, k in kept if own[k].kind == "base"})))
                cols["labels"].append(",".join(sorted({own[k].label for _, _, k in kept})))
                cols["score"].append(max((CERTAINTY[own[k].kind] for _, _, k in kept), default=0.0))
                cols["detections"].append(",".join(f"{own[k].label}:{a}:{b}" for a, b, k in kept if own[k].kind != "base"))
            return cols

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"
    return map_slices(docs.select(id_col, F.col(text_col).cast("binary")), make, schema)
