"""Byte automata: a small regex syntax, subset construction, minimisation.

Syntax: literals, ``\\xHH`` and escaped literals, ``[...]`` classes, groups with
``|``, and the quantifiers ``? * + {m} {m,n}``. Everything is over bytes.
"""

from __future__ import annotations

from collections import defaultdict

ALL = frozenset(range(256))


class _Parser:
    def __init__(self, text: str, fold: bool):
        self.s, self.i, self.fold = text, 0, fold

    def cased(self, chars: set[int]) -> frozenset[int]:
        if not self.fold:
            return frozenset(chars)
        return frozenset(chars | {ord(chr(c).swapcase()) for c in chars if c < 128 and chr(c).isalpha()})

    def parse(self):
        node = self.either()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i}")
        return node

    def either(self):
        options = [self.sequence()]
        while self.i < len(self.s) and self.s[self.i] == "|":
            self.i += 1
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self.repeat(self.atom()))
        return ("seq", parts)

    def escape(self) -> int:
        self.i += 1
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def atom(self):
        c = self.s[self.i]
        if c == "(":
            self.i += 1
            node = self.either()
            self.i += 1
            return node
        if c == "[":
            return ("set", self.charset())
        if c == "\\":
            return ("set", self.cased({self.escape()}))
        self.i += 1
        return ("set", self.cased({ord(c)}))

    def charset(self) -> frozenset[int]:
        self.i += 1
        negated = self.s[self.i] == "^"
        self.i += negated
        chars: set[int] = set()
        while self.s[self.i] != "]":
            low = self.escape() if self.s[self.i] == "\\" else ord(self.s[self.i])
            if self.s[self.i - 1] != "\\" and low == ord(self.s[self.i]):
                self.i += 1
            high = low
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                if self.s[self.i] == "\\":
                    high = self.escape()
                else:
                    high = ord(self.s[self.i])
                    self.i += 1
            chars.update(range(low, high + 1))
        self.i += 1
        found = self.cased(chars)
        return ALL - found if negated else found

    def repeat(self, node):
        while self.i < len(self.s) and self.s[self.i] in "?*+{":
            c = self.s[self.i]
            self.i += 1
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : end].partition(",")
                self.i = end + 1
                least = int(low)
                most = (int(high) if high else None) if comma else least
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, least, most)
        return node


def reverse(node):
    """The tree of the reversed language."""
    if node[0] == "set":
        return node
    if node[0] == "seq":
        return ("seq", [reverse(x) for x in reversed(node[1])])
    if node[0] == "or":
        return ("or", [reverse(x) for x in node[1]])
    return ("rep", reverse(node[1]), node[2], node[3])


def parse(pattern: str, fold: bool = False):
    return _Parser(pattern, fold).parse()


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def build(self, node, start: int) -> int:
        """Adds ``node`` behind ``start``; returns its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            here = self.state()
            self.empty[start].append(here)
            self.step[here] = (node[1], end)
            return end
        if kind == "seq":
            for part in node[1]:
                start = self.build(part, start)
            return start
        end = self.state()
        if kind == "or":
            for part in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.build(part, first)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.build(part, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[loop].append(end)
            self.empty[self.build(part, loop)].append(loop)
            return end
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.build(part, start)
            self.empty[start].append(end)
        return end

    def close(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Dfa:
    """Minimal automaton of some trees.

    ``classes`` maps a byte to its class; ``table[state + class]`` is the next
    state, states being multiples of ``width``; states of at least ``accepts``
    accept, and ``labels[state]`` is the tuple of trees they accept. With
    ``anywhere`` a match may begin at any byte; otherwise ``dead`` is the state
    that nothing leaves.
    """

    def __init__(self, trees, anywhere: bool):
        nfa = _Nfa()
        starts = [nfa.state() for _ in trees]
        ends = {nfa.build(tree, s): k for k, (tree, s) in enumerate(zip(trees, starts))}
        sets = {x[0] for x in nfa.step if x}
        groups: dict[tuple, list[int]] = defaultdict(list)
        ordered = sorted(sets, key=sorted)
        for b in range(256):
            groups[tuple(b in s for s in ordered)].append(b)
        members = list(groups.values())
        width = len(members)
        self.classes = bytearray(256)
        for c, bytes_ in enumerate(members):
            for b in bytes_:
                self.classes[b] = c

        root = nfa.close(starts)
        known, rows, todo = {root: 0}, [], [root]
        while todo:
            now = todo.pop(0)
            row = []
            for c in range(width):
                b = members[c][0]
                to = {nfa.step[s][1] for s in now if nfa.step[s] and b in nfa.step[s][0]}
                goal = nfa.close(to | set(starts)) if anywhere else nfa.close(to)
                if goal not in known:
                    known[goal] = len(known)
                    todo.append(goal)
                row.append(known[goal])
            rows.append(row)
        labels = [tuple(sorted(ends[s] for s in states if s in ends)) for states in known]

        block = {label: k for k, label in enumerate(dict.fromkeys(labels))}
        part = [block[label] for label in labels]
        while True:  # Moore's refinement
            seen: dict[tuple, int] = {}
            finer = [seen.setdefault((part[i], *(part[t] for t in rows[i])), len(seen)) for i in range(len(rows))]
            if len(seen) == len(set(part)):
                break
            part = finer
        first: dict[int, int] = {}
        for i, p in enumerate(part):
            first.setdefault(p, i)
        order = sorted(first, key=lambda p: (bool(labels[first[p]]), first[p]))
        place = {p: k * width for k, p in enumerate(order)}
        self.width = width
        self.start = place[part[0]]
        self.table = [place[part[t]] for p in order for t in rows[first[p]]]
        self.labels = {place[p]: labels[first[p]] for p in order if labels[first[p]]}
        self.accepts = min(self.labels, default=len(order) * width)
        self.dead = next((s for s in place.values() if s not in self.labels and all(t == s for t in self.table[s : s + width])), -1)
        self.size = len(order)
