"""Slide markers in a text that arrives in chunks.

What comes out does not depend on where the chunks are cut, so the definition is
one over whole texts. These markers are known, and the earliest counts:

- a bracket that begins with ``slide`` and has a number, ``[slide:3]``;
- another bracket with ``slide`` and a number behind it, ``[see slide 3]``;
- a line ``Slide 3``, ``Slide 3/10`` or ``Slide 3 of 10``, also with ``·``, ``:`` or
  ``-`` behind it; the rest of such a line goes;
- a line ``slide:3]``, whose bracket was lost.

A bracket has up to ``BRACKET`` characters on one line; one with ``slide`` but no
number above 0 is taken out and is no marker. A line begins behind a line feed, at
the text's start and behind a marker. Behind a marker the first line that is not
blank is the slide's title if it is a heading, is labelled ``Title:`` or
``Headline:`` (an empty label takes the next line) or is a line of up to ``TITLE``
characters without ``.``, ``!`` or ``?``; a line is taken as it is, without a title,
once ``PENDING`` characters have no line feed. Each slide is announced once; at the
end, those that were expected and never marked are announced without a title.
"""

from __future__ import annotations

import regex

#: Fixed values, in characters.
PENDING, TITLE = 160, 80
BRACKET = 120
_BRACKET = regex.compile(r"\[([^\[\]\n]{0,120})\]", regex.I)
_OPEN = regex.compile(r"\[[^\[\]\n]{0,120}\Z")
_LABEL = r"[\t ]{0,40}slide[\t ]{1,40}(\d{1,9})(?:[\t ]{0,40}(?:/|of)[\t ]{0,40}\d{1,9})?[\t ]{0,40}"
_LINE = regex.compile(rf"(?i)(?:{_LABEL}(?:[·:-]|(?=\n))|[\t ]{{0,40}}slide[\t ]{{0,40}}:[\t ]{{0,40}}(\d{{1,9}})\][\t ]{{0,40}}(?=\n))")
_TITLED = regex.compile(r"(?i)(?:#{1,6}\s+)?(?:title|headline)\s*:\s*(.*)")
_HEADING = regex.compile(r"#{1,6}\s+(\S.*)")
#: More than any unfinished line marker has.
_HELD = 400

Event = tuple[str, int | None, str | None]


def number(bracket: str) -> int | None:
    """The slide that a bracket's text names: None if it is no slide bracket, 0 if it names none."""
    low = bracket.lower()
    at = low.find("slide")
    if at < 0:
        return None
    m = regex.search(r"\d{1,9}", low, pos=at)
    return int(m[0]) if m else 0


class Segmenter:
    """Feeds on chunks and returns events: ("slide", number, title) and ("text", None, text)."""

    def __init__(self, state: dict | None = None):
        s = state or {}
        self.tail, self.fresh, self.skips = s.get("tail", ""), s.get("fresh", True), s.get("skips", False)
        self.slide, self.pending, self.seen = s.get("slide"), s.get("pending", ""), set(s.get("seen", []))

    def state(self) -> dict:
        return {"tail": self.tail, "fresh": self.fresh, "skips": self.skips, "slide": self.slide, "pending": self.pending, "seen": sorted(self.seen)}

    def feed(self, chunk: str | None) -> list[Event]:
        return self._read(self.tail + (chunk or ""), False)

    def finish(self, expected: range | list[int] = ()) -> list[Event]:
        out = self._read(self.tail, True)
        out += self._resolve(True)
        for k in expected:
            out += self._announce(k, None)
        return out

    def _read(self, text: str, last: bool) -> list[Event]:
        out, at = [], 0
        whole = text + "\n" if last else text  # the end ends a line
        while at < len(text):
            if self.skips:
                end = text.find("\n", at)
                if end < 0:
                    self.tail = ""
                    return out
                at, self.skips, self.fresh = end, False, False
            found = self._next(whole, at, len(text))
            if found is None:
                break
            start, end, slide, skips = found
            out += self._text(text[at:start])
            before, at = at, end
            if slide:
                out += self._resolve(True)
                self.slide, self.pending, self.fresh, self.skips = slide, "", True, skips
            else:
                # a bracket taken out leaves the line as it was
                self.fresh = self.fresh if start == before else text[start - 1] == "\n"
        rest = text[at:]
        held = len(rest) if last else self._held(rest)
        out += self._text(rest[:held])
        if rest[:held]:
            self.fresh = rest[:held].endswith("\n")
        self.tail = rest[held:]
        return out

    def _next(self, text: str, at: int, size: int) -> tuple[int, int, int, bool] | None:
        """(start, end, slide, whether the line's rest goes) of the earliest marker."""
        best = None
        for m in _BRACKET.finditer(text, at):
            slide = number(m[1])
            if slide is not None:
                best = (m.start(), m.end(), slide, False)
                break
        limit = best[0] if best else size
        start = at if self.fresh else text.find("\n", at) + 1
        while start and start < limit or start == at and self.fresh and start < limit:
            m = _LINE.match(text, start)
            slide = int(m[1] or m[2]) if m else 0
            if slide > 0:
                return start, m.end(), slide, m[1] is not None and not text.startswith("\n", m.end())
            end = text.find("\n", start)
            if end < 0:
                break
            start = end + 1
        return best

    def _held(self, rest: str) -> int:
        """From where the end of ``rest`` may yet become a marker."""
        held = len(rest)
        if m := _OPEN.search(rest, max(0, held - BRACKET - 2)):
            held = m.start()
        line = rest.rfind("\n") + 1
        if (line or self.fresh) and len(rest) - line <= _HELD:
            m = _LINE.fullmatch(rest, line, partial=True)
            if m and m.partial:
                held = min(held, line)
        return held

    def _text(self, text: str) -> list[Event]:
        if not text:
            return []
        if self.slide is None:
            return [("text", None, text)]
        self.pending += text
        return self._resolve(False)

    def _resolve(self, forced: bool) -> list[Event]:
        """The pending slide with its title, once that is decided, and the text behind it."""
        if self.slide is None:
            return []
        body = self.pending.lstrip()
        line, used = self._line(body, 0, forced)
        if line is None:
            return []
        title = None
        if m := _TITLED.fullmatch(line):
            title = m[1]
            if not title:
                title, more = self._line(body, used, forced)
                if title is None:
                    return []
                used = more if title else used
        elif m := _HEADING.fullmatch(line):
            title = m[1]
        elif 0 < len(line) <= TITLE and not regex.search("[.!?]", line):
            title = line
        else:
            used = 0
        title = " ".join(title.split()) if title else None
        out = self._announce(self.slide, title)
        rest = body[used:]
        self.slide, self.pending = None, ""
        return out + ([("text", None, rest)] if rest else [])

    def _line(self, body: str, at: int, forced: bool) -> tuple[str | None, int]:
        """(line, behind it) of the first line from ``at`` that is not blank: None
        if it may yet go on, empty if it is too long for a title."""
        at += len(body) - at - len(body[at:].lstrip())
        end = body.find("\n", at, at + PENDING)
        if end >= 0:
            return body[at:end].strip(), end + 1
        if len(body) - at >= PENDING:
            return "", at
        return (body[at:].strip(), len(body)) if forced else (None, at)

    def _announce(self, slide: int, title: str | None) -> list[Event]:
        if slide in self.seen:
            return []
        self.seen.add(slide)
        return [("slide", slide, title)]


def joined(events: list[Event]) -> list[Event]:
    """Events with neighbouring texts as one."""
    out: list[Event] = []
    for e in events:
        if e[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", None, out[-1][2] + e[2])
        else:
            out.append(e)
    return out
