"""Text scalars as Column expressions: everything here stays in codegen.

Lengths and positions count code points. Null in gives null out unless said
otherwise; an empty string is a value of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: White space as text processing on the web understands it; a fixed value.
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same, as the characters themselves.
BLANKS = "\t\n\x0B\f\r \u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Code points that show nothing; a fixed value.
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2069}\x{FEFF}\x{E0000}-\x{E007F}]"
#: Entities in the order in which they are decoded; fixed values.
HTML_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#x2F;", "/"), ("&nbsp;", " "))
XML_ENTITIES = (("&amp;", "&"), ("&#38;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
#: What stands where the middle of a text was cut out; a fixed value.
OMISSION = "\n\n[… middle truncated to fit length budget …]\n\n"
LEAST_SPLIT = len(OMISSION) + 400


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a ``value`` that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def trim_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def strip_invisible(text: Column) -> Column:
    """A text of as many bytes as code points holds none and is not searched."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(text, INVISIBLE, ""))


def _squeezed(text: Column) -> Column:
    plain = F.regexp_replace(F.replace(text, F.lit("\u00A0"), F.lit(" ")), r"\t[\t ]*| [\t ]+", " ")
    return F.array_join(F.filter(F.transform(F.split(plain, "\n"), trim), lambda x: x != ""), "\n")


def normalize_for_prompt(text: Column) -> Column:
    """Invisible code points out, blanks and line breaks squeezed, ends trimmed."""
    return _squeezed(strip_invisible(text))


normalize_whitespace = normalize_for_prompt


def normalize_transcript_text(text: Column) -> Column:
    return _squeezed(text)


def normalize_transcript_lines(lines: Column) -> Column:
    """Lines joined and normalised; null if nothing is left."""
    return F.nullif(normalize_transcript_text(F.array_join(lines, "\n")), F.lit(""))


def replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def decode_html_entities(text: Column) -> Column:
    return replaced(text, HTML_ENTITIES)


def decode_xml_entities(text: Column) -> Column:
    return replaced(text, XML_ENTITIES)


def normalize_candidate(text: Column) -> Column:
    """One line without outer blanks, null if blank."""
    return F.nullif(trim(F.regexp_replace(text, rf"[{SPACE}]+", " ")), F.lit(""))


def first_text(*candidates: Column) -> Column:
    return F.coalesce(*map(normalize_candidate, candidates))


def last_index(text: Column, part: str) -> Column:
    """0-based place of the last ``part``, -1 if there is none."""
    back = F.instr(F.reverse(text), part[::-1])
    return F.when(back > 0, F.length(text) - back - len(part) + 1).otherwise(-1)


def clip_at_sentence(text: Column, most: int) -> Column:
    """At most ``most`` code points, ending behind a sentence if one ends in the second half."""
    head = F.substring(text, 1, most)
    end = F.greatest(*(last_index(head, p) for p in (". ", "! ", "? ", "\n\n")))
    clipped = F.when(end > most * 0.5, F.substring(head, F.lit(1), end + 1)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(clipped)


def clip_head_and_tail(text: Column, most: int) -> Column:
    """At most ``most`` code points: three quarters of the room for the head, the
    rest for the tail, each cut at a nearby sentence or line end."""
    if most <= LEAST_SPLIT:
        return clip_at_sentence(text, most)
    room = most - len(OMISSION)
    first = room * 3 // 4
    rest = room - first

    def to_break(head: Column) -> Column:
        end = F.greatest(*(last_index(head, p) for p in (". ", "! ", "? ", "\n")))
        return bound(end, lambda end: F.when(end > first * 0.5, F.substring(head, F.lit(1), end + 1)).otherwise(head))

    def from_break(tail: Column) -> Column:
        start = F.least(*(F.nullif(F.instr(tail, p), F.lit(0)) - 1 for p in ("\n", ". ", "! ", "? ")), F.lit(rest))
        return bound(start, lambda start: F.when(start < rest * 0.5, F.substring(tail, start + 2, F.length(tail))).otherwise(tail))

    head, tail = bound(F.left(text, F.lit(first)), to_break), bound(F.right(text, F.lit(rest)), from_break)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(trim_end(head), F.lit(OMISSION), trim_start(tail)))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of ``words_of``, without a search for other than ASCII blanks where there are none."""

    def count(bare: Column) -> Column:
        ascii_ = F.octet_length(bare) == F.length(bare)
        return F.when(bare == "", 0).when(ascii_, F.size(F.split(bare, "[\\t-\\r ]+"))).otherwise(F.size(F.split(bare, rf"[{SPACE}]+")))

    return bound(trim(text), count)


def content_budget(text: Column, most: int) -> Column:
    """struct(content, truncated, total_characters, word_count)."""
    rest = lambda c: F.struct(c.alias("content"), (F.length(text) > most).alias("truncated"), F.length(text).alias("total_characters"), word_count(c).alias("word_count"))
    return bound(trim(clip_head_and_tail(text, most)), rest)


def transcript_counts(text: Column) -> Column:
    """struct(characters, lines, words), each null where it would be 0."""
    lines = F.size(F.filter(F.split(text, r"\r?\n"), lambda x: trim(x) != ""))
    zero = lambda c: F.nullif(c, F.lit(0))
    return F.struct(zero(F.length(text)).alias("characters"), zero(lines).alias("lines"), zero(word_count(text)).alias("words"))


def strip_leading_title(content: Column, title: Column) -> Column:
    """Content without the title it begins with in any case, and what blank or
    control characters follow it."""
    body, name = trim_start(content), trim(title)
    starts = F.startswith(F.lower(body), F.lower(name)) & (name != "")
    rest = F.regexp_replace(F.substring(body, F.length(name) + 1, F.length(body)), rf"^[{SPACE}\p{{Cntrl}}]+", "")
    return F.when(title.isNull() | content.isNull() | ~starts, content).otherwise(rest)


def truncate_words(text: Column, most: int | Column, ending: str = "...") -> Column:
    """Cut before the last blank in the first ``most`` code points, with ``ending``."""
    head = trim_end(F.substring(text, F.lit(1), F.lit(most) if isinstance(most, int) else most))
    whole = trim(F.regexp_replace(head, rf"[{SPACE}]+[^{SPACE}]*\z", ""))
    cut = F.when(whole != "", whole).otherwise(trim(head))
    return F.when(F.length(text) <= most, text).when(cut == "", "").otherwise(F.concat(cut, F.lit(ending)))


def clean_ocr(text: Column) -> Column:
    """Lines that hold something to read: two characters, an alphanumeric one,
    and a blank if they are over twenty long."""
    lines = F.transform(F.split(text, "\n"), lambda x: normalize_transcript_text(x))
    kept = F.filter(lines, lambda x: (F.length(x) >= 2) & ~((F.length(x) > 20) & ~F.contains(x, F.lit(" "))) & x.rlike(r"[A-Za-z0-9]"))
    return F.array_join(kept, "\n")


def ocr_confidence(text: Column) -> Column:
    alnum = F.length(F.regexp_replace(text, r"[^A-Za-z0-9]", ""))
    return F.when(F.length(text) == 0, 0.0).otherwise(F.least(F.lit(1.0), alnum / F.length(text)))


def append_note(note: Column, more: Column) -> Column:
    return F.when(F.coalesce(note, F.lit("")) == "", more).otherwise(F.concat_ws("; ", note, more))


def tagged_block(text: Column, tag: str) -> Column:
    """What stands between a tag's first start and the next end, trimmed; null if absent."""
    pattern = rf"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(text.rlike(pattern), trim(F.regexp_extract(text, pattern, 1)))


def slug(text: Column, most: int = 64) -> Column:
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(plain, r"^-+|-+$", ""), 1, most), r"-+$", "")


def source_id(host: Column, title: Column, url: Column) -> Column:
    return F.concat_ws("-", F.nullif(slug(host), F.lit("")), F.nullif(slug(title), F.lit("")), F.substring(F.sha1(url), 1, 8))


def sanitize_json_prefix(text: Column) -> Column:
    return F.regexp_replace(text, r"^\)\]\}'[^\n]*\n?", "")


def parameter_billions(name: Column) -> Column:
    """The largest ``<number>b`` in a model's name, or null."""
    found = F.regexp_extract_all(F.lower(name), F.lit(r"(?:^|[^a-z0-9])[a-z]?(\d+(?:\.\d+)?)b(?![a-z0-9])"), F.lit(1))
    return F.nullif(F.array_max(F.transform(found, lambda x: x.cast("double"))), F.lit(0.0))


def token_estimate(text: Column) -> Column:
    """A quarter of the length, rounded up: an estimate, not a tokenizer's count."""
    return F.ceil(F.length(text) / 4)


def cache_key(*parts: Column) -> Column:
    """Digest of the parts as JSON, nulls kept."""
    fields = F.struct(*(p.alias(f"p{k}") for k, p in enumerate(parts)))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def markdown_paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n{2,}"), trim), lambda x: x != "")


def intro_paragraph(text: Column, sentences: int = 3) -> Column:
    """The first paragraph that is no heading, at most three sentences of it."""
    first = F.get(F.filter(markdown_paragraphs(text), lambda x: ~F.startswith(x, F.lit("#"))), F.lit(0))
    parts = F.regexp_extract_all(first, F.lit(r"(?s)[^.!?]+[.!?]+|[^.!?]+\z"), F.lit(0))
    return trim(F.array_join(F.transform(F.slice(parts, 1, sentences), trim), " "))


def slide_markers(text: Column) -> Column:
    """Numbers of all ``[slide:n]`` markers, in order; a marker of 0 counts as none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\[slide:(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.filter(found, lambda n: n > 0)


def split_at_slides(text: Column) -> Column:
    """struct(summary, slides): the text before and from the earliest mark of a slides section."""
    marks = [F.regexp_instr(text, F.lit(p)) for p in (r"(?im)^#{1,3}\s+slides\b", r"(?im)^\s*\[slide:\d+\]", r"(?im)^slide\s+\d+\s*[:·.]")]
    at = F.least(*(F.when(m > 0, m) for m in marks))
    whole = F.struct(trim(text).alias("summary"), F.lit(None).cast("string").alias("slides"))
    parts = F.struct(trim(F.substring(text, F.lit(1), at - 1)).alias("summary"), trim(F.substring(text, at, F.length(text))).alias("slides"))
    return F.when(at.isNull(), whole).otherwise(parts)
