"""Secret scan: all rules in one automaton, one pass over the bytes.

Each rule is a head expression followed by a run of one or more tail bytes.
The heads, each with one tail byte, become one minimal automaton that starts
anywhere; a text's bytes go through its transition array once. Where the
automaton accepts, the rule's reversed automaton finds the leftmost start and
the run of tail bytes gives the end, so spans are leftmost-longest and do not
overlap within a kind. Runs that are too short are dropped after they have
used up their text, as a regex engine would do. In every rule the match that
ends first also starts first, which that order relies on. A private key's span
goes from its BEGIN line to its END line, or over headers and base64 lines.

Defined results: a null or empty text has no spans (counts 0, the digest of
the empty string); equal rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from loomtext.llm.automaton import Dfa, parse, reverse
from loomtext.llm.rows import map_slices


@dataclass(frozen=True)
class Rule:
    """``head`` then a run of bytes of ``tail``; ``least`` counts the bytes of
    the run, or of the whole match if ``whole``. An empty tail ends at the head."""

    kind: str
    head: str
    tail: str
    least: int
    whole: bool = False
    fold: bool = False


BASE = ("assign", "access", "hex")
#: Hex runs enter the automaton at their eighth digit, which keeps it small.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 6, fold=True),
    Rule("access", r"AKIA", r"[A-Z0-9]", 20, whole=True),
    Rule("hex", r"[0-9a-f]{7}", r"[0-9a-f]", 24, whole=True),
    #: The header's last dash is the tail; ``key_end`` finds where the key ends.
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]{0,20}PRIVATE KEY( BLOCK)?----", r"-", 1),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]", 36),
    Rule("gitlab", r"glpat-", r"[A-Za-z0-9_-]", 20),
    Rule("slack", r"xox[abposr]-", r"[A-Za-z0-9-]", 10),
    Rule("stripe", r"[rs]k_live_", r"[A-Za-z0-9]", 16),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]", 35),
)
_FOLLOW = bytes(range(0x80, 0xC0))


_KEY_STOP = re.compile(rb"-----END [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----")
#: A header such as ``DEK-Info:`` or a line of base64, also where line feeds are written as escapes.
_KEY_LINE = re.compile(rb"[ \t]*(?:(?:[A-Za-z0-9+/]{16,}=*|[A-Za-z0-9+/]*=+[A-Za-z0-9+/]*)(?P<key>)|[A-Za-z][A-Za-z-]*:[^\r\n\\]*)?(?:[ \t]*(?:\\[nr]|[\r\n]))*")


def key_end(data: bytes, at: int) -> int:
    """Where a private key ends whose BEGIN line ends at ``at``: behind its END line,
    if that comes before another BEGIN, else behind the last line of base64 of
    those that follow as headers or base64."""
    limit = data.find(b"-----BEGIN", at)
    limit = len(data) if limit < 0 else limit
    stop = _KEY_STOP.search(data, at, limit)
    if stop:
        return stop.end()
    end = i = at
    if re.compile(rb"[ \t]+[^ \t\r\n\\]").match(data, at):
        return at  # other words on its line
    while i < limit:
        m = _KEY_LINE.match(data, i, limit)
        if m.end() == i:
            break
        end = m.end("key") if m["key"] is not None else end
        i = m.end()
    return end


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [parse(f"({r.head}){r.tail}", r.fold) for r in rules]
        self.dfa = Dfa(trees, anywhere=True)
        self.back = [Dfa([reverse(t)], anywhere=False) for t in trees]
        self.tails = [frozenset(parse(r.tail, r.fold)[1][0][1]) for r in rules]
        self.classes = bytes(self.dfa.classes)

    def start(self, k: int, data: bytes, end: int, floor: int) -> int:
        """The leftmost start of rule k's match that ends at ``end``."""
        dfa = self.back[k]
        table, classes, state, found = dfa.table, dfa.classes, dfa.start, -1
        for i in range(end - 1, floor - 1, -1):
            state = table[state + classes[data[i]]]
            if state >= dfa.accepts:
                found = i
            elif state == dfa.dead:
                break
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start and rule."""
        table, accepts, state, hits = self.dfa.table, self.dfa.accepts, self.dfa.start, []
        for i, c in enumerate(data.translate(self.classes), 1):
            state = table[state + c]
            if state >= accepts:
                hits.append((i, state))
        if not hits:
            return []
        ends, out, labels = [0] * len(self.rules), [], self.dfa.labels
        for at, state in hits:
            for k in labels[state]:
                if at <= ends[k]:
                    continue
                begin = self.start(k, data, at, ends[k])
                if begin < 0:
                    continue
                tail, end, size = self.tails[k], at, len(data)
                while end < size and data[end] in tail:
                    end += 1
                rule = self.rules[k]
                if rule.kind == "private_key":
                    end = key_end(data, end)
                ends[k] = end
                if (end - begin if rule.whole else end - at + 1) >= rule.least:
                    out.append((begin, end, k))
        out.sort(key=lambda x: (x[0], x[2]))
        return out

    def code_points(self, data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if data.isascii():
            return spans
        where, done, count = {}, 0, 0
        for p in sorted({p for s in spans for p in s[:2]}):
            count += len(data[done:p].translate(None, _FOLLOW))
            where[p], done = count, p
        return [(where[a], where[b], k) for a, b, k in spans]

    def redacted(self, data: bytes, spans: list[tuple[int, int, int]]) -> bytes:
        """The text with each stretch of overlapping spans replaced by its first kind."""
        out, done = [], 0
        for a, b, k in spans:
            if a >= done:
                out += [data[done:a], b"[" + self.rules[k].kind.upper().encode() + b"]"]
            done = max(done, b)
        return b"".join([*out, data[done:]])


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id, counts of the base kinds, digest, spans."""

    def make():
        scan = scanner(rules)
        base = [r.kind in BASE for r in rules]

        def run(ids, texts):
            cols = {c: [] for c in (id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans")}
            for key, data in zip(ids, texts):
                data = data or b""
                spans = scan.code_points(data, scan.spans(data))
                kinds = [rules[k].kind for _, _, k in spans]
                shown = [f"{kind}:{a}:{b}" for kind, (a, b, _) in zip(kinds, spans)]
                cols[id_col].append(key)
                for kind in BASE:
                    cols[f"n_{kind}"].append(kinds.count(kind))
                cols["base_sha256"].append(hashlib.sha256(",".join(s for s, x in zip(shown, spans) if base[x[2]]).encode()).hexdigest())
                cols["spans"].append(",".join(shown))
                cols["n_spans"].append(len(shown))
            return cols

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"
    return map_slices(docs.select(id_col, F.col(text_col).cast("binary")), make, schema)


def redact_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; rows, order of
    columns and all other columns stay, null texts stay null."""

    def make():
        scan = scanner(rules)

        def run(*columns):
            texts = columns[at]
            clean = [x if x is None or not (s := scan.spans(x)) else scan.redacted(x, s) for x in texts]
            return {name: clean if i == at else columns[i] for i, name in enumerate(names)}

        return run

    names, at = docs.columns, docs.columns.index(text_col)
    raw = docs.withColumn(text_col, F.col(text_col).cast("binary"))
    return map_slices(raw, make, raw.schema).withColumn(text_col, F.col(text_col).cast("string"))
