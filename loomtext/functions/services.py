"""What is read from services' answers and decided about attachments, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomtext.functions import payloads as P, scan, text as T, urls

#: Providers: documents, streaming and video; fixed values.
CAPABILITIES = {"xai": (False, True, False), "openai": (True, True, False), "google": (True, True, True), "anthropic": (True, True, False), "zai": (False, True, False), "nvidia": (False, True, False)}
#: Names under which a key may be given; fixed values.
KEY_NAMES = {"GEMINI_API_KEY": ("GEMINI_API_KEY", "GOOGLE_GENERATIVE_AI_API_KEY", "GOOGLE_API_KEY"), "Z_AI_API_KEY": ("Z_AI_API_KEY", "ZAI_API_KEY")}


def capability(provider: Column, what: str) -> Column:
    at = ("documents", "streaming", "video").index(what)
    return F.coalesce(provider.isin(*(p for p, c in CAPABILITIES.items() if c[at])), F.lit(False))


def has_key(required: Column, given: Column) -> Column:
    """Whether any of the names of a key is among the ``given``."""
    names = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in KEY_NAMES.items() for x in pair))
    return F.coalesce(F.arrays_overlap(F.coalesce(names[required], F.array(required)), given), F.lit(False))


def can_stream(provider: Column, transport: Column, attachments: Column) -> Column:
    documents = F.exists(F.coalesce(attachments, F.array().cast("array<string>")), lambda a: a == "document")
    return (transport != "cli") & ~documents & capability(provider, "streaming")


def streaming_unsupported(message: Column, url: Column) -> Column:
    at_stream = F.contains(F.coalesce(url, F.lit("")), F.lit(":streamGenerateContent")) | F.contains(message, F.lit("streamGenerateContent"))
    return at_stream & message.rlike("(?i)does not support|not supported|Call ListModels|supported methods")


def is_timeout(message: Column) -> Column:
    return F.coalesce(message.rlike("(?i)timed out"), F.lit(False))


def document_handling(kind: Column, has_text: Column, size: Column, mode: Column, native: Column, provider: Column, most: int = 50 << 20) -> Column:
    """inline, attach, preprocess or error for an attachment."""
    can = (mode != "always") & native & capability(provider, "documents")
    out = F.when((kind != "file") | has_text, "inline").when(size.isNull(), "error").when(can & (size <= most), "attach")
    return out.when(mode == "off", "error").otherwise("preprocess")


def audio_name(name: Column, kind: Column) -> Column:
    """A file name with an extension: its own or that of its media type, mp3 if unknown."""
    known = {"audio/mpeg": "mp3", "audio/mp3": "mp3", "audio/mpga": "mp3", "video/mp4": "mp4", "audio/mp4": "mp4", "application/mp4": "mp4", "audio/x-wav": "wav", "audio/wav": "wav", "audio/flac": "flac", "audio/webm": "webm", "video/webm": "webm", "audio/ogg": "ogg", "audio/oga": "ogg", "application/ogg": "ogg"}
    base = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("media"))
    ext = F.coalesce(F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[urls.media_type(kind)], F.lit("mp3"))
    return F.when(base.rlike(r"^.+\.[^.]+\z"), base).otherwise(F.concat(base, F.lit("."), ext))


def content_length(header: Column) -> Column:
    n = F.trim(header).try_cast("double")
    return F.when(n > 0, F.floor(n).cast("long"))


def url_filename(url: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(urls.path(url), r"[^/]*\z", 0)), F.lit(""))


def first_bytes(data: Column, n: int) -> Column:
    return F.substring(data, 1, n)


def candidate_text(raw: Column) -> Column:
    """struct(text, stopped): the parts of all candidates joined, and why there are none if not for STOP."""
    each = F.try_variant_get(P.parsed(raw), "$.candidates", "array<variant>")
    parts = F.flatten(F.transform(each, lambda c: F.coalesce(F.try_variant_get(c, "$.content.parts", "array<variant>"), F.array().cast("array<variant>"))))
    said = F.nullif(F.trim(F.array_join(F.transform(parts, lambda p: F.coalesce(P.field(p, "$.text"), F.lit(""))), "")), F.lit(""))
    why = F.get(F.filter(F.transform(each, lambda c: F.trim(P.field(c, "$.finishReason"))), lambda r: r != ""), F.lit(0))
    return F.struct(said.alias("text"), F.when(said.isNull() & (why != "STOP"), why).alias("stopped"))


def model_ids(raw: Column) -> Column:
    """Sorted distinct ids of a model list: ``data[].id`` or ``models[]``."""
    v = P.parsed(raw)
    data = F.transform(F.try_variant_get(v, "$.data", "array<variant>"), lambda x: F.trim(P.field(x, "$.id")))
    models = F.transform(F.try_variant_get(v, "$.models", "array<variant>"), lambda x: F.trim(P.field(x, "$")))
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(data, models, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))


def request_body(raw: Column) -> Column:
    """The fields of a request, of the right types or defaults, and what is wrong with it."""
    v = P.parsed(raw)
    words = lambda p: F.trim(P.field(v, p))
    limit = F.coalesce(P.field(v, "$.maxExtractCharacters", "double"), P.field(v, "$.maxCharacters", "double"))
    mode, form, url = F.lower(words("$.mode")), F.lower(words("$.format")), words("$.url")
    return F.struct(
        url.alias("url"), words("$.title").alias("title"), F.coalesce(P.field(v, "$.text"), F.lit("")).alias("text"), F.nullif(words("$.model"), F.lit("")).alias("model"),
        F.when(mode.isin("url", "page"), mode).otherwise("auto").alias("mode"), F.when(form.isin("markdown", "md"), "markdown").otherwise("text").alias("format"),
        F.when(limit > 0, limit).alias("max_characters"), F.coalesce(F.try_variant_get(v, "$.noCache", "boolean"), F.lit(False)).alias("no_cache"),
        F.when(~F.coalesce(url.rlike("(?i)^https?://"), F.lit(False)), "missing url").when((mode == "page") & (F.coalesce(F.trim(P.field(v, "$.text")), F.lit("")) == ""), "missing text").alias("problem"),
    )


def scraped_markdown(raw: Column) -> Column:
    """Markdown of a scraper's answer: under data or at the top, by markdown, content, text."""
    v = P.parsed(raw)
    paths = ("$.data.markdown", "$.markdown", "$.data.content", "$.content", "$.data.text", "$.text")
    return F.coalesce(*(F.nullif(F.trim(P.field(v, p)), F.lit("")) for p in paths))


def scraped_metadata(raw: Column) -> Column:
    """struct(title, description, site_name) of a scraper's answer."""
    v = P.parsed(raw)
    get = lambda *names: T.first_text(*(P.field(v, f"$.metadata.{n}") for n in names))
    return F.struct(get("title", "ogTitle").alias("title"), get("description", "ogDescription").alias("description"), get("siteName", "ogSiteName").alias("site_name"))


def player_response(page: Column) -> Column:
    """The player's answer that a page's script holds, as a variant."""
    return F.try_parse_json(scan.balanced_object_col(page, F.lit("ytInitialPlayerResponse")))


def player_facts(v: Column) -> Column:
    """struct(title, description, seconds, tracks) of a player's answer."""
    get = lambda p: F.nullif(F.trim(P.field(v, p)), F.lit(""))
    seconds = F.coalesce(P.field(v, "$.videoDetails.lengthSeconds").try_cast("double"), P.field(v, "$.videoDetails.lengthSeconds", "double"))
    tracks = F.try_variant_get(v, "$.captions.playerCaptionsTracklistRenderer.captionTracks", "array<struct<languageCode:string,kind:string,baseUrl:string>>")
    track = F.transform(tracks, lambda t: F.struct(F.coalesce(t["languageCode"], F.lit("")).alias("language"), F.coalesce(t["kind"], F.lit("")).alias("kind"), t["baseUrl"].alias("url")))
    return F.struct(get("$.videoDetails.title").alias("title"), get("$.videoDetails.shortDescription").alias("description"), F.when(seconds > 0, seconds).alias("seconds"), track.alias("tracks"))


def playability_reason(v: Column) -> Column:
    """The reason a player gives, from its several places."""
    def runs(p: str) -> Column:
        items = F.try_variant_get(v, p, "array<variant>")
        return T.normalize_candidate(F.array_join(F.transform(items, lambda r: F.coalesce(P.field(r, "$.text"), F.lit(""))), " "))

    out = [T.normalize_candidate(P.field(v, "$.playabilityStatus.reason"))]
    for base in ("$.playabilityStatus.errorScreen.playerErrorMessageRenderer", "$.playabilityStatus.errorScreen"):
        for name in ("reason", "subreason"):
            out += [T.normalize_candidate(P.field(v, f"{base}.{name}.simpleText")), runs(f"{base}.{name}.runs")]
    return F.coalesce(*out)


def panel_segments(raw: Column) -> Column:
    """Segments of a transcript panel's answer; null if none."""
    path = "$.actions[0].updateEngagementPanelAction.content.transcriptRenderer.content.transcriptSearchPanelRenderer.body.transcriptSegmentListRenderer.initialSegments"
    items = F.try_variant_get(P.parsed(raw), path, "array<variant>")
    base = "$.transcriptSegmentRenderer"
    said = lambda s: F.trim(F.regexp_replace(F.array_join(F.transform(F.try_variant_get(s, f"{base}.snippet.runs", "array<variant>"), lambda r: F.coalesce(P.field(r, "$.text"), F.lit(""))), ""), r"\s+", " "))
    ms = lambda s, name: F.try_variant_get(s, f"{base}.{name}", "string").try_cast("bigint")
    rows = F.filter(F.transform(items, lambda s: F.struct(ms(s, "startMs").alias("startMs"), ms(s, "endMs").alias("endMs"), said(s).alias("text"))), lambda s: s["text"] != "")
    return F.when(F.size(rows) > 0, rows)


def podcast_embed(page: Column) -> Column:
    """struct(show, episode, seconds, format) of an embedded player's page data; null without both titles."""
    v = P.parsed(F.regexp_extract(page, r"(?is)<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>", 1))
    base = "$.props.pageProps.state.data"
    show, episode = (F.nullif(F.trim(P.field(v, f"{base}.entity.{n}")), F.lit("")) for n in ("subtitle", "title"))
    return F.when(show.isNotNull() & episode.isNotNull(), F.struct(show.alias("show"), episode.alias("episode"), (P.field(v, f"{base}.entity.duration", "double") / 1000).alias("seconds"), P.field(v, f"{base}.defaultAudioFileObject.format").alias("format")))


def is_encrypted(form: Column) -> Column:
    return F.coalesce(form.rlike("(?i)cbcs|cenc"), F.lit(False))


def looks_like_preview(transcript_chars: Column, seconds: Column) -> Column:
    """A transcript too short for its episode."""
    return (transcript_chars < 200) | ((transcript_chars < 800) & (seconds.isNull() | (seconds >= 600)))


def apple_title(page: Column) -> Column:
    get = lambda kind, name: F.nullif(F.trim(F.regexp_extract(page, rf"(?i)<meta\s+{kind}=[\"']{name}[\"']\s+content=[\"']([^\"']+)[\"']", 1)), F.lit(""))
    return F.coalesce(get("name", "apple:title"), get("property", "og:title"))


def embedded_url(page: Column, field: str) -> Column:
    """A string field of JSON within a page, its escapes decoded."""
    raw = F.regexp_extract(page, rf'(?i)"{field}":("(?:\\.|[^"\\])*")', 1)
    return P.field(F.try_parse_json(F.nullif(raw, F.lit(""))), "$")


def clipped_to_tokens(text: Column, most: int) -> Column:
    """Head and tail of a text within an estimated ``most`` tokens."""
    return F.when(T.token_estimate(text) <= most, text).otherwise(T.clip_head_and_tail(text, most * 4))


def moved_to_front(items: Column, preferred: Column) -> Column:
    return F.when(F.array_contains(items, preferred), F.concat(F.array(preferred), F.array_remove(items, preferred))).otherwise(items)


def chain_label(names: Column) -> Column:
    return F.array_join(names, "->")


def bands_problem(low: Column, high: Column) -> Column:
    return F.when((low < 0) | (high < 0), "negative bound").when(low > high, "bounds out of order")


def finish_line(elapsed: Column, model: Column, words: Column, cost: Column) -> Column:
    """Parts that are known, joined by middle dots."""
    return F.concat_ws(" · ", elapsed, F.when(words > 0, F.concat(F.format_number(words, 0), F.lit(" words"))), model, cost)


def transcript_payload(raw: Column) -> Column:
    """Transcript of a JSON payload in one of three shapes: a string, records with
    a text each (others are skipped), one record with a text; null if nothing is left."""
    v = P.parsed(raw)
    said = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.trim(P.field(x, "$.text"))), lambda t: t != "")
    return F.coalesce(T.normalize_transcript_lines(said), F.nullif(T.normalize_transcript_text(F.coalesce(P.field(v, "$"), P.field(v, "$.text"))), F.lit("")))


#: Phrases of pages that are walls, in lower case; fixed values.
WALLS = "access denied|attention required|captcha|cloudflare|enable javascript|forbidden|please turn javascript on|verify you are human"


def looks_blocked(page: Column) -> Column:
    """Whether the head of a page says that it is a wall; embedded page data tell of a real page."""
    head = F.lower(F.left(page, F.lit(20_000)))
    walled = head.rlike(WALLS)
    return F.coalesce(walled & ~F.contains(head, F.lit("__next_data__")), F.lit(False))


def with_local_models(candidates: Column, enabled: Column, models: Column, last: Column, allowed: Column) -> Column:
    """Candidates behind the local tools' models, the tool that last succeeded
    first, where a run allows local tools; ``models`` maps tools to model names."""
    order = moved_to_front(enabled, last)
    name = lambda p: F.nullif(F.trim(F.try_element_at(models, p)), F.lit(""))
    ids = F.array_distinct(F.transform(order, lambda p: F.concat_ws("/", F.lit("cli"), p, name(p))))
    return F.when(F.coalesce(allowed, F.lit(False)) & (F.size(enabled) > 0), F.concat(ids, candidates)).otherwise(candidates)


def temperature_for(provider: Column, model: Column, temperature: Column) -> Column:
    """The temperature to send: none to models that take no other than their own."""
    fixed = (provider == "openai") & model.rlike(r"(?i)\Agpt-5([-.].+)?\z")
    return F.when(~F.coalesce(fixed, F.lit(False)), temperature)


def model_after_empty(model: Column) -> Column:
    """What to ask when a trial model answers nothing; null if it is none. The model's name is a fixed value."""
    plain, stable = F.lower(F.trim(model)), "google/gemini-2.5-flash"
    return F.when(F.startswith(plain, F.lit("google/")) & plain.rlike("/.*(preview|exp)") & (plain != stable), F.lit(stable))


def share_text(done: Column, total: Column) -> Column:
    """`` 33%``, or nothing where the share is not known."""
    known = (total > 0) & (total < float("inf")) & (F.abs(done) < float("inf"))
    return F.coalesce(F.when(known, F.concat(F.lit(" "), F.least(F.greatest(F.round(done / total * 100), F.lit(0)), F.lit(100)).cast("int").cast("string"), F.lit("%"))), F.lit(""))


def progress_text(e: Column) -> Column:
    """What a progress event (struct of kind, service, reason, hint, client, ok, done, total,
    seconds, total_seconds, part, parts) says to its reader; null for other kinds."""
    of = lambda text: F.concat(e["service"], F.lit(f": {text}"))
    either = lambda yes, no: F.when(F.coalesce(e["ok"], F.lit(False)), yes).otherwise(no)
    by_time, by_part = share_text(e["seconds"], e["total_seconds"]), share_text(e["part"].cast("double"), F.when(e["parts"] != 0, F.greatest(e["parts"].cast("double"), F.lit(1.0))))
    texts = {
        "fetch-html-start": F.lit("Fetching…"), "firecrawl-start": F.concat(F.lit("Firecrawl… ("), e["reason"], F.lit(")")), "firecrawl-done": either(F.lit("Firecrawl: done"), F.lit("Firecrawl: failed")),
        "transcript-start": F.coalesce(F.nullif(F.trim(e["hint"]), F.lit("")), F.lit("Transcript…")), "transcript-media-download-start": of("downloading audio…"),
        "transcript-media-download-progress": F.concat(of("downloading audio…"), share_text(e["done"], e["total"])), "transcript-whisper-start": of("transcribing…"),
        "transcript-whisper-progress": F.concat(of("transcribing…"), F.when(by_time != "", by_time).otherwise(by_part)), "transcript-done": either(of("transcript ready"), of("transcript unavailable")),
        "bird-start": F.concat(F.lit("X: extracting tweet"), F.coalesce(F.concat(F.lit(" ("), F.nullif(e["client"], F.lit("")), F.lit(")")), F.lit("")), F.lit("…")), "bird-done": either(F.lit("X: extracted tweet"), F.lit("X: extract failed")),
        "nitter-start": F.lit("X: extracting tweet (nitter)…"), "nitter-done": either(F.lit("X: extracted tweet"), F.lit("X: extract failed")),
    }
    out = F.lit(None).cast("string")
    for kind, text in texts.items():
        out = F.when(e["kind"] == kind, text).otherwise(out)
    return out
