"""ASCII-folded words of UTF-8 texts, in pieces of bounded size.

A-Z are lower-cased; a word is a run of ASCII letters, digits and bytes of
characters beyond ASCII. Everything else stands between words.
"""

from __future__ import annotations

from collections.abc import Iterator

PIECE = 1 << 20
_FOLD = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_runs(data: bytes | None, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists that each come from about ``size``
    bytes (more only where one word is longer); null has none."""
    at, end = 0, len(data or b"")
    while at < end:
        to = at + size
        while to < end and _FOLD[data[to]] != 32:
            to += 1
        found = data[at:to].translate(_FOLD).split()
        if found:
            yield found
        at = to
