"""Scans that no Column expression does well: balanced JSON, dotenv, stream folds."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType


def balanced_object(text: str, token: str) -> str | None:
    """The object that opens behind ``token``, with its nested ones; quotes and escapes are seen."""
    at = text.find(token)
    at = text.find("{", at) if at >= 0 else -1
    depth, quote, i = 0, "", at
    while 0 <= i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[at : i + 1]
        i += 1
    return None


def dotenv(text: str) -> dict[str, str]:
    out = {}
    for line in text.split("\n"):
        m = re.fullmatch(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*", line)
        if m:
            value = m[2]
            out[m[1]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else re.sub(r"\s+#.*$", "", value)
    return out


#: Characters compared from the start and at most overlapping, and how
#: much of the text so far a chunk must repeat to count as a corrected resend.
COMPARED, OVERLAP, SLACK, SHARE = 4096, 2048, 64, 0.9


def shared_head(a: str, b: str) -> int:
    """How many characters two texts begin with alike, by bisection."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def continued(head: str, tail: str) -> int:
    """The longest beginning of ``head`` that ends ``tail``: wherever its first
    characters stand, from the left, it is compared with the rest of ``tail``."""
    size, first = len(tail), head[:4]
    at = max(0, size - len(head))
    while first and (at := tail.find(first, at)) >= 0:
        if head.startswith(tail[at:]):
            return size - at
        at += 1
    return next((n for n in range(min(3, len(head), size), 0, -1) if tail.endswith(head[:n])), 0)


def merge_chunk(before: str, chunk: str) -> tuple[str, str]:
    """(text, appended) after a chunk of a stream that may resend what it sent: all
    of it, a part, nearly all of it, or an overlap of up to OVERLAP characters."""
    if not chunk:
        return before, ""
    old, new = ("\n".join(x.replace("\r\n", "\n").split("\r")) for x in (before, chunk))
    alike = shared_head(old, new)
    if alike == len(new):
        return (old, "") if old else (new, new)
    first = min(alike, COMPARED)
    resent = alike == len(old) or len(new) >= len(old) and first >= max(len(old) - SLACK, int(len(old) * SHARE), 1)
    if resent:
        known = alike if alike == len(old) else first
        return new, new[known:]
    most = min(len(old), len(new), OVERLAP)
    added = new[continued(new[:most], old[-most:]) :]
    return old + added, added


def gate(states: list[str], lines: bool) -> list[str]:
    """What is written for the successive states of a text: whole lines, or what
    is new, or everything again where a state does not continue the one before."""
    out, done, before = [], 0, ""
    for text in states:
        if done == 0:
            done = len(text) - len(text.lstrip("\n"))
        piece = ""
        if lines:
            end = text.rfind("\n") + 1
            if end > done:
                piece, done = text[done:end], end
        elif not text.startswith(before):
            piece, done = text, len(text)
        elif len(text) > done:
            piece, done = text[done:], len(text)
        out.append(piece)
        before = text
    return out


balanced_object_col = F.udf(lambda t, k: None if t is None else balanced_object(t, k), StringType(), useArrow=True)
dotenv_col = F.udf(lambda t: None if t is None else dotenv(t), MapType(StringType(), StringType()), useArrow=True)
