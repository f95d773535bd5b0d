"""JSON payloads of captions, feeds, models and messages, by VARIANT paths.

A payload that is no JSON gives null, as does a field of the wrong type.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomtext.functions import clock, text as T


def parsed(raw: Column) -> Column:
    return F.try_parse_json(raw)


def field(v: Column, path: str, kind: str = "string") -> Column:
    """A field if it is of the kind asked for: a number is no string."""
    got = F.try_variant_get(v, path, "variant")
    named = F.schema_of_variant(got)
    ok = named == "STRING" if kind == "string" else named.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")
    return F.when(ok, F.try_variant_get(v, path, kind))


def _usage(prompt: Column, completion: Column, total: Column | None) -> Column:
    both = prompt + completion
    total = both if total is None else F.coalesce(total, both)
    known = prompt.isNotNull() | completion.isNotNull() | total.isNotNull()
    return F.when(known, F.struct(prompt.alias("prompt"), completion.alias("completion"), total.alias("total")))


def usage(raw: Column, shape: str) -> Column:
    """struct(prompt, completion, total) of the shapes plain, anthropic, openai, google, or null."""
    v, n = parsed(raw), lambda p: field(v, p, "bigint")
    if shape == "plain":
        total = n("$.totalTokens")
        known = n("$.input").isNotNull() | n("$.output").isNotNull() | total.isNotNull()
        return F.when(known, F.struct(n("$.input").alias("prompt"), n("$.output").alias("completion"), total.alias("total")))
    if shape == "anthropic":
        return _usage(n("$.input_tokens"), n("$.output_tokens"), None)
    if shape == "openai":
        return _usage(n("$.input_tokens"), n("$.output_tokens"), n("$.total_tokens"))
    return _usage(n("$.promptTokenCount"), n("$.candidatesTokenCount"), n("$.totalTokenCount"))


def model_sums(stats: Column) -> Column:
    """Token sums over a map of models to usage JSON; a figure that no model has is null, a total of 0 falls back to the parts."""
    each = lambda p: F.transform(F.map_values(stats), lambda raw: field(F.try_parse_json(raw), p, "bigint"))
    total_of = lambda a: F.when(F.exists(a, lambda x: x.isNotNull()), F.aggregate(F.array_compact(a), F.lit(0).cast("bigint"), lambda s, x: s + x))
    prompt, completion = total_of(each("$.prompt")), total_of(each("$.completion"))
    total = F.coalesce(F.nullif(total_of(each("$.total")), F.lit(0)), prompt + completion)
    return F.struct(prompt.alias("prompt"), completion.alias("completion"), total.alias("total"))


def last_json(output: Column) -> Column:
    """The output as JSON, or what stands behind its last line that begins with a brace."""
    plain = T.trim(output)
    tail = F.regexp_extract(plain, r"(?s).*\n(\{.*)\z", 1)
    return F.coalesce(F.when(plain.rlike(r"^[\[{]"), parsed(plain)), parsed(F.nullif(tail, F.lit(""))))


def result_text(output: Column) -> Column:
    """First non-blank of the result fields of a command's JSON output."""
    said = lambda v, name: T.bound(T.trim(field(v, f"$.{name}")), lambda x: F.nullif(x, F.lit("")))
    return T.bound(last_json(output), lambda v: F.coalesce(*(said(v, name) for name in ("result", "response", "output", "message", "text"))))


def json_lines(output: Column) -> Column:
    lines = F.filter(F.split(output, r"\r?\n"), lambda x: F.startswith(F.trim(x), F.lit("{")))
    return F.array_compact(F.transform(lines, lambda x: F.try_parse_json(x)))


def jsonl_usage(output: Column) -> Column:
    """struct(prompt, completion, cost): tokens of the last line that has usage, cost of the first that has one."""
    rows = json_lines(output)
    n = lambda v, p, kind: F.try_variant_get(v, p, kind)
    used = F.filter(rows, lambda v: n(v, "$.usage.input_tokens", "bigint").isNotNull() | n(v, "$.usage.output_tokens", "bigint").isNotNull())
    costs = F.array_compact(F.transform(rows, lambda v: F.coalesce(n(v, "$.total_cost_usd", "double"), n(v, "$.cost_usd", "double"))))
    last = F.try_element_at(used, F.lit(-1))
    return F.struct(n(last, "$.usage.input_tokens", "bigint").alias("prompt"), n(last, "$.usage.output_tokens", "bigint").alias("completion"), F.get(costs, F.lit(0)).alias("cost"))


def duration_line(output: Column) -> Column:
    """The positive duration of the first line that is a JSON object with one."""
    found = F.transform(json_lines(output), lambda v: F.try_variant_get(v, "$.duration", "double"))
    return F.get(F.filter(found, lambda d: d > 0), F.lit(0))


def download_progress(line: Column) -> Column:
    """struct(done, total) of ``progress:done|total|estimate`` lines."""
    parts = F.split(F.regexp_extract(line, r"progress:(.*)$", 1), r"\|")
    n = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    total = F.coalesce(F.when(n(1) > 0, n(1)), F.when(n(2) > 0, n(2)))
    return F.when(line.rlike("progress:") & n(0).isNotNull(), F.struct(n(0).alias("done"), total.alias("total")))


def _any(found: Column) -> Column:
    return T.bound(found, lambda f: F.when(F.size(f) > 0, f))


def _clock_ms(text: Column) -> Column:
    return T.bound(text, clock.parse_clock_ms)


def _time_ms(text: Column, seconds: bool = False) -> Column:
    return T.bound(text, lambda x: clock.parse_time_ms(x, seconds))


_SEGMENT = "array<struct<startMs:bigint,endMs:bigint,text:string>>"


def _segments(items: Column) -> Column:
    """Segments of an array of variants; times in milliseconds or seconds, texts under text or utf8."""
    def when(v, ms, seconds):
        as_text = lambda p: F.try_variant_get(v, p, "string")
        return F.coalesce(_time_ms(as_text(ms)), _time_ms(as_text(seconds), True))

    rows = F.transform(items, lambda v: F.struct(when(v, "$.startMs", "$.start").alias("startMs"), when(v, "$.endMs", "$.end").alias("endMs"), F.trim(F.regexp_replace(F.coalesce(field(v, "$.text"), field(v, "$.utf8")), r"\s+", " ")).alias("text")))
    return F.filter(rows, lambda s: s["startMs"].isNotNull() & (s["text"] != "")).cast(_SEGMENT)


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.segments", "array<variant>"))


def json_segments(raw: Column) -> Column:
    """Segments of a JSON transcript: an array, or an object with ``segments``; null if none."""
    return _any(_segments(T.bound(parsed(raw), _items)))


def json_transcript_text(raw: Column) -> Column:
    """Text of a JSON transcript: transcript, text, or the segments' texts by line."""
    blank = lambda c: T.bound(F.trim(c), lambda x: F.nullif(x, F.lit("")))

    def text(v):
        said = F.array_join(F.transform(_segments(_items(v)), lambda s: s["text"]), "\n")
        loose = F.array_join(F.filter(F.transform(_items(v), lambda x: F.trim(field(x, "$.text"))), lambda x: x != ""), "\n")
        return F.coalesce(blank(field(v, "$.transcript")), blank(field(v, "$.text")), blank(said), blank(loose))

    return T.bound(parsed(raw), lambda v: F.when(v.isNotNull(), text(v)))


def timed_events(raw: Column) -> Column:
    """Segments of a caption payload of events with start, duration and pieces; null if none."""
    events = F.try_variant_get(parsed(raw), "$.events", "array<variant>")
    ms = lambda e, p: _time_ms(F.try_variant_get(e, p, "string"))
    said = lambda e: F.trim(F.array_join(F.transform(F.try_variant_get(e, "$.segs", "array<variant>"), lambda s: F.coalesce(field(s, "$.utf8"), F.lit(""))), ""))
    rows = F.transform(events, lambda e: F.struct(ms(e, "$.tStartMs").alias("startMs"), (ms(e, "$.tStartMs") + ms(e, "$.dDurationMs")).alias("endMs"), F.regexp_replace(said(e), r"\s+", " ").alias("text")))
    found = F.filter(rows, lambda s: s["startMs"].isNotNull() & (s["text"] != ""))
    return _any(found)


def xml_captions(raw: Column) -> Column:
    """Segments of ``<text start dur>`` elements, times in seconds; null if none."""
    tags = F.regexp_extract_all(raw, F.lit(r"(?is)<text[^>]*>.*?</text>"), F.lit(0))
    attr = lambda t, name: F.nullif(F.regexp_extract(t, rf"(?i)\b{name}\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))
    ms = lambda t, name: _time_ms(attr(t, name), True)
    body = lambda t: F.trim(F.regexp_replace(T.decode_html_entities(F.regexp_extract(t, r"(?is)<text[^>]*>(.*?)</text>", 1)), r"\s+", " "))
    rows = F.transform(tags, lambda t: F.struct(ms(t, "start").alias("startMs"), (ms(t, "start") + ms(t, "dur")).alias("endMs"), body(t).alias("text")))
    found = F.filter(rows, lambda s: s["startMs"].isNotNull() & (s["text"] != ""))
    return _any(found)


def vtt_segments(raw: Column) -> Column:
    """Cues of a VTT text: start and end, text lines up to a blank one joined;
    notes, styles and cues without a start left out; null if none."""
    note = r"(?i)^(NOTE|STYLE|REGION)\b"
    lines = F.transform(F.split(F.replace(raw, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.trim(x))
    empty = F.struct(F.array().cast("array<struct<head:string,text:array<string>>>").alias("cues"), F.lit(False).alias("open"))

    def step(s, line):
        last = F.size(s["cues"])
        new = F.struct(line.alias("head"), F.array().cast("array<string>").alias("text"))
        grown = F.transform(s["cues"], lambda c, i: F.when(i == last - 1, F.struct(c["head"].alias("head"), F.concat(c["text"], F.array(line)).alias("text"))).otherwise(c))
        return (
            F.when(s["open"] & (line == ""), F.struct(s["cues"].alias("cues"), F.lit(False).alias("open")))
            .when(s["open"] & line.rlike(note), s)
            .when(s["open"], F.struct(grown.alias("cues"), F.lit(True).alias("open")))
            .when(F.contains(line, F.lit("-->")) & ~line.rlike(note), F.struct(F.concat(s["cues"], F.array(new)).alias("cues"), F.lit(True).alias("open")))
            .otherwise(s)
        )

    cues = F.aggregate(lines, empty, step, lambda s: s["cues"])
    side = lambda c, n: F.trim(F.split_part(c["head"], F.lit("-->"), F.lit(n)))
    rows = F.transform(cues, lambda c: F.struct(_clock_ms(side(c, 1)).alias("startMs"), _clock_ms(F.split_part(F.regexp_replace(side(c, 2), r"\s+", " "), F.lit(" "), F.lit(1))).alias("endMs"), F.trim(F.regexp_replace(F.array_join(c["text"], " "), r"\s+", " ")).alias("text")))
    found = F.filter(rows, lambda s: s["startMs"].isNotNull() & (s["text"] != ""))
    return _any(found)


def segments_text(segments: Column) -> Column:
    return T.bound(F.trim(F.array_join(F.transform(segments, lambda s: s["text"]), "\n")), lambda x: F.nullif(x, F.lit("")))


def vtt_text(raw: Column) -> Column:
    """Cue texts by line, or without cues the lines that are no markup of the format."""
    lines = F.transform(F.split(F.replace(raw, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.trim(x))
    plain = F.filter(lines, lambda x: (x != "") & (F.upper(x) != "WEBVTT") & ~x.rlike(r"^\d+\z") & ~x.rlike(r"(?i)^(NOTE|STYLE|REGION)\b") & ~F.contains(x, F.lit("-->")))
    return F.coalesce(segments_text(vtt_segments(raw)), F.array_join(plain, "\n"))


def caption_tracks(manual: Column, automatic: Column, skip_automatic: bool = False) -> Column:
    """Tracks (language, kind, url) in order of preference, the first of each
    language: human before automatic, English before others, then as given."""
    both = manual if skip_automatic else F.concat(manual, automatic)
    rank = lambda t, i: F.struct(F.when(t["kind"] == "asr", 1).otherwise(0).alias("asr"), F.when(t["language"].rlike("^en(-|$)"), 0).otherwise(1).alias("other"), i.alias("pos"), t.alias("track"))
    ranked = F.transform(F.array_sort(F.transform(both, rank)), lambda r: r["track"])
    known = lambda order, t, i: F.exists(F.slice(order, F.lit(1), i), lambda p: (F.lower(p["language"]) == F.lower(t["language"])) & (t["language"] != ""))
    return T.bound(ranked, lambda order: F.filter(order, lambda t, i: ~known(order, t, i)))


# feeds

def is_feed(xml: Column) -> Column:
    return F.coalesce(F.lower(F.substring(xml, 1, 4096)).rlike("<rss|<feed"), F.lit(False))


def _cdata(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?i)<!\[CDATA\[|\]\]>", ""))


def item_seconds(item: Column) -> Column:
    """Duration in seconds of ``s``, ``m:s`` or ``h:m:s``; null unless positive."""
    raw = _cdata(F.regexp_extract(item, r"(?is)<itunes:duration>(.*?)</itunes:duration>", 1))
    return T.bound(_clock_ms(raw), lambda ms: F.when(ms > 0, F.round(ms / 1000).cast("long")))


def enclosure_url(item: Column) -> Column:
    plain = F.regexp_extract(item, r"(?is)<enclosure\b[^>]*\burl\s*=\s*[\"']([^\"']+)[\"']", 1)
    atom = F.regexp_extract(item, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']enclosure[\"'][^>]*\bhref\s*=\s*[\"']([^\"']+)[\"']", 1)
    return F.coalesce(F.nullif(plain, F.lit("")), F.nullif(atom, F.lit("")))


def feed_items(xml: Column) -> Column:
    """array(title, url, seconds) of a feed's items."""
    items = F.regexp_extract_all(xml, F.lit(r"(?is)<item\b.*?</item>"), F.lit(0))
    title = lambda i: F.nullif(_cdata(F.regexp_extract(i, r"(?is)<title>(.*?)</title>", 1)), F.lit(""))
    return F.transform(items, lambda i: F.struct(title(i).alias("title"), enclosure_url(i).alias("url"), item_seconds(i).alias("seconds")))


#: Letters with marks and what is left of them; fixed values of common Latin letters.
_MARKED = "àáâãäåèéêëìíîïòóôõöùúûüýÿçñ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuyycn"


def loose_title(title: Column) -> Column:
    """Lower case, Latin letters without marks, words and digits only."""
    bare = F.translate(F.regexp_replace(F.lower(title), r"\p{M}+", ""), _MARKED, _PLAIN)
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def episode_of(xml: Column, title: Column) -> Column:
    """First item with an enclosure whose loose title is that of ``title``."""
    return T.bound(loose_title(title), lambda wanted: F.get(F.filter(feed_items(xml), lambda i: (loose_title(i["title"]) == wanted) & i["url"].isNotNull()), F.lit(0)))


def transcript_candidates(item: Column) -> Column:
    tags = F.regexp_extract_all(item, F.lit(r"(?is)<podcast:transcript\b[^>]*>"), F.lit(0))
    attr = lambda t, name: F.nullif(F.trim(F.regexp_extract(t, rf"(?is)\b{name}\s*=\s*[\"']([^\"']+)[\"']", 1)), F.lit(""))
    return F.filter(F.transform(tags, lambda t: F.struct(attr(t, "url").alias("url"), attr(t, "type").alias("type"))), lambda c: c["url"].isNotNull())


def preferred_transcript(candidates: Column) -> Column:
    """JSON before VTT before the first."""
    kind = lambda c: F.lower(F.trim(F.split_part(F.coalesce(c["type"], F.lit("")), F.lit(";"), F.lit(1))))
    rank = lambda c: F.when((kind(c) == "application/json") | F.endswith(F.lower(c["url"]), F.lit(".json")), 0).when((kind(c) == "text/vtt") | F.endswith(F.lower(c["url"]), F.lit(".vtt")), 1).otherwise(2)
    return F.array_min(F.transform(candidates, lambda c, i: F.struct(rank(c).alias("rank"), i.alias("pos"), c.alias("c"))))["c"]


# messages and video pages

def message_text(raw: Column) -> Column:
    """The longest of a message's text, note and article (its title in front unless in it)."""
    v = parsed(raw)
    get = lambda p: F.nullif(F.trim(field(v, p)), F.lit(""))
    title, body = get("$.data.article.title"), F.coalesce(*(get(f"$.data.article.{n}") for n in ("text", "body", "preview_text", "excerpt")))
    article = F.when(title.isNotNull() & body.isNotNull() & ~F.contains(body, title), F.concat(title, F.lit("\n\n"), body)).otherwise(F.coalesce(body, title))
    options = F.filter(F.array(get("$.data.text"), get("$.data.note_tweet.text"), article), lambda x: x.isNotNull())
    return F.array_max(F.transform(options, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]


def message_author(raw: Column) -> Column:
    """struct(name, username) of the included user whose id is the author's."""
    users = lambda v: F.try_variant_get(v, "$.includes.users", "array<struct<id:string,name:string,username:string>>")
    first = lambda v: T.bound(field(v, "$.data.author_id"), lambda own: F.get(F.filter(users(v), lambda u: u["id"] == own), F.lit(0)))
    return T.bound(T.bound(parsed(raw), first), lambda hit: F.when(hit.isNotNull(), F.struct(hit["name"].alias("name"), hit["username"].alias("username"))))


def best_variant(variants: Column) -> Column:
    """URL of the MP4 with the highest bit rate, earlier ones first."""
    mp4 = F.filter(variants, lambda x: F.lower(x["content_type"]) == "video/mp4")
    return F.array_max(F.transform(mp4, lambda x, i: F.struct(F.coalesce(x["bit_rate"], F.lit(0)).alias("rate"), (-i).alias("i"), x["url"].alias("url"))))["url"]


def probe(raw: Column) -> Column:
    """struct(seconds, width, height): last video stream's duration, else the format's; first width and height."""
    streams = F.try_variant_get(parsed(raw), "$.streams", "array<variant>")
    video = F.filter(streams, lambda s: F.try_variant_get(s, "$.codec_type", "string") == "video")
    number = lambda s, p: F.try_variant_get(s, p, "string").try_cast("double")
    seconds = F.filter(F.transform(video, lambda s: number(s, "$.duration")), lambda d: d > 0)
    whole = number(parsed(raw), "$.format.duration")
    first = lambda p: F.get(F.array_compact(F.transform(video, lambda s: field(s, p, "int"))), F.lit(0))
    return F.struct(F.coalesce(F.try_element_at(seconds, F.lit(-1)), F.when(whole > 0, whole)).alias("seconds"), first("$.width").alias("width"), first("$.height").alias("height"))


def showinfo_time(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("showinfo")), F.nullif(F.regexp_extract(line, r"pts_time:(\d+\.?\d*)", 1), F.lit("")).try_cast("double"))


def percent(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"(\d{1,3}(?:\.\d+)?)%", 1), F.lit("")).try_cast("double")


#: Marks of pages that stand before a video; fixed values.
CONSENT_MARKS = ("consent.youtube.com", "before you continue to youtube")
BOT_MARKS = ("unusual traffic", "our systems have detected", "g-recaptcha", "not a robot")


def availability(html: Column, status: Column, reason: Column) -> Column:
    """Why a video cannot be had, or null; the order of the tests counts."""
    low, why, state = F.lower(html), F.coalesce(F.lower(reason), F.lit("")), F.upper(F.trim(status))
    any_of = lambda marks: F.coalesce(low.rlike("|".join(m.replace(".", r"\.") for m in marks)), F.lit(False))
    out = F.when(any_of(BOT_MARKS), "bot_check").when(any_of(CONSENT_MARKS), "consent_interstitial").when(state.isNull() | state.isin("", "OK"), None)
    out = out.when((state == "CONTENT_CHECK_REQUIRED") | why.rlike("confirm your age|inappropriate for some users"), "age_restricted")
    out = out.when(state == "LOGIN_REQUIRED", F.when(F.contains(why, F.lit("age")), "age_restricted").otherwise("login_required"))
    out = out.when(F.contains(why, F.lit("private")), "private_video").when(F.contains(why, F.lit("member")), "members_only").when(why.rlike("country|region"), "geo_restricted")
    return out.when(state.isin("UNPLAYABLE", "ERROR"), "video_unavailable")


def sse_event(name: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), data, F.lit("\n\n"))


SSE_EVENTS = ("meta", "slides", "status", "chunk", "assistant", "metrics", "done", "error")


def parse_sse(message: Column) -> Column:
    """struct(event, data) of a message of a known kind, else null."""
    name = F.regexp_extract(message, r"(?m)^event: (.*)$", 1)
    return F.when(name.isin(*SSE_EVENTS), F.struct(name.alias("event"), F.regexp_extract(message, r"(?m)^data: (.*)$", 1).alias("data")))
