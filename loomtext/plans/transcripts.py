"""Who is asked for a transcript, in which order, and what is noted on the way.

Each function returns the steps of a chain (see ``operators.chains``); services are
injected by name. A service adds ``value`` and, where it fails, ``note`` or, for
transcription, ``failure``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtext.functions import payloads, services as V
from loomtext.operators.chains import Service, Step, resolve

#: Transcription services in their order, and their names in notes; fixed values.
HOSTED = {"assemblyai": "AssemblyAI", "gemini": "Gemini", "openai": "OpenAI", "fal": "FAL"}
AUDIO_FACTS = {"failure": "string", "failed": "string"}


def video_steps(answers: dict[str, Service], mode: Column, page: Column, can_download: Column, has_token: Column) -> list[Step]:
    """Steps for videos by ``mode`` (auto, web, no-auto, yt-dlp, apify): captions by
    hand, the page's own captions, a download's transcription, a scraper. Without
    a page only ``apify`` goes on; without what a mode is for, it ends."""
    def said(service: Service, note: Column) -> Service:
        return lambda rows: service(rows).withColumn("note", F.when(F.coalesce(F.trim("value"), F.lit("")) == "", note))

    nothing = F.lit(None).cast("string")
    end = lambda note: lambda rows: rows.withColumns({"settled": F.lit(True), "note": F.lit(note)})
    downloads = mode.isin("yt-dlp", "no-auto") | (mode == "auto") & can_download
    return [
        Step("page", end("no page"), (mode != "apify") & (F.coalesce(F.trim(page), F.lit("")) == ""), quiet=True),
        Step("binary", end("no downloader"), (mode == "yt-dlp") & ~F.coalesce(can_download, F.lit(False)), quiet=True),
        Step("token", end("no scraper token"), (mode == "apify") & ~F.coalesce(has_token, F.lit(False)), quiet=True),
        Step("manual", said(answers["manual"], F.lit("no captions by hand, transcribing")), mode == "no-auto"),
        Step("captions", said(answers["captions"], nothing), mode.isin("auto", "web")),
        Step("download", said(answers["download"], F.when(mode == "auto", F.lit("transcription failed, trying the scraper"))), downloads),
        Step("apify", said(answers["apify"], nothing), has_token & mode.isin("auto", "apify")),
        Step("none", lambda rows: rows.withColumn("note", F.lit("unavailable")), quiet=True),
    ]


def audio_steps(answers: dict[str, Service], keys: Column, media_type: Column) -> list[Step]:
    """Steps for sound: groq, the local models, then the hosted services whose key is
    among ``keys`` (an array), ``fal`` for audio only. A failure is noted with those that
    come next; the last one that failed is named in ``failed``."""
    audio = F.startswith(F.lower(media_type), F.lit("audio/"))
    able = {p: F.array_contains(keys, p) & (audio if p == "fal" else F.lit(True)) for p in HOSTED}

    def asking(name: str, label: str, later: Column) -> Service:
        def ask(rows: DataFrame) -> DataFrame:
            got = answers[name](rows.withColumn("failure", F.lit(None).cast("string")))
            failed = (F.coalesce(F.trim("value"), F.lit("")) == "") & F.col("failure").isNotNull()
            note = F.when(failed & (later != ""), F.concat(F.lit(f"{label} transcription failed; falling back to "), later, F.lit(": "), F.col("failure")))
            return got.withColumns({"note": note, "failed": F.when(failed, F.lit(name)).otherwise(F.col("failed"))})

        return ask

    steps = [Step("groq", asking("groq", "Groq", F.lit("local/AssemblyAI/Gemini/OpenAI")), F.array_contains(keys, "groq"))]
    steps += [Step(p, asking(p, p, F.lit("")), None) for p in ("onnx", "whisper") if p in answers]
    names = list(HOSTED)
    for i, p in enumerate(names):
        later = F.concat_ws("/", *(F.when(able[q], F.lit(HOSTED[q])) for q in names[i + 1 :])) if names[i + 1 :] else F.lit("")
        steps.append(Step(p, asking(p, HOSTED[p], later), able[p]))
    return steps


#: What a podcast chain learns of a row.
PODCAST_FACTS = {
    "embed": "string", "show": "string", "episode": "string", "audio": "string", "drm": "string", "seconds": "double", "feed_url": "string", "feed_status": "int", "feed": "string", "media": "string", "failure": "string", "kind": "string",
}


def podcast_steps(answers: dict[str, Service], audio_of: Column) -> list[Step]:
    """Steps for an episode's page: its embedded player's data and sound; the show's
    feed from a directory, or the episode from a search where there is none; the
    feed's own transcript; its enclosure; the search again where the feed lacks the
    episode. Services: ``embed`` (adds embed), ``transcribe`` (of media: value,
    failure), ``directory`` (of show: feed_url), ``feed`` (of feed_url: feed_status,
    feed), ``search`` (of show and episode: media), ``feed_transcript`` (of
    media, a transcript's address: value). ``audio_of``: the sound's address in
    ``embed``. What fails for good is settled with its reason as last note."""
    none = F.lit(None).cast("string")

    def learned(rows: DataFrame) -> DataFrame:
        facts = V.podcast_embed(F.col("embed"))
        got = answers["embed"](rows).withColumns({"show": facts["show"], "episode": facts["episode"], "drm": facts["format"], "seconds": facts["seconds"], "audio": audio_of})
        missing = F.col("show").isNull()
        sealed = F.col("audio").isNotNull() & V.is_encrypted(F.col("drm"))
        note = F.when(missing, "embedded data not found").when(sealed, F.concat(F.lit("embedded sound is encrypted ("), F.col("drm"), F.lit("), trying the feed")))
        return got.withColumns({"settled": missing, "note": note})

    def transcribed(media: Column, kind: str, preview: bool = False, final: str | None = None) -> Service:
        def ask(rows: DataFrame) -> DataFrame:
            got = answers["transcribe"](rows.withColumns({"media": media, "failure": none}))
            chars = F.length(F.trim("value"))
            short = F.coalesce((chars > 0) & V.looks_like_preview(chars, F.col("seconds")), F.lit(False)) if preview else F.lit(False)
            failed = F.coalesce(F.trim("value"), F.lit("")) == ""
            reason = F.coalesce(F.col("failure"), F.lit("unknown error"))
            note = F.when(short, F.concat(F.lit("embedded sound is a clip of "), chars.cast("string"), F.lit(" characters, trying the feed"))).when(failed, F.coalesce(F.lit(final), F.concat(F.lit("transcription failed: "), reason)))
            # asked last, by its first value: what is short is no value
            return got.withColumns({"note": note, "settled": F.lit(final is not None) & failed, "kind": F.when(~failed & ~short, kind), "value": F.when(~short, F.col("value"))})

        return ask

    item = payloads.episode_of(F.col("feed"), F.col("episode"))

    def fed(rows: DataFrame) -> DataFrame:
        got = answers["feed"](rows)
        bad = ~F.coalesce(F.col("feed_status").between(200, 299), F.lit(False))
        return got.withColumns({"settled": bad, "note": F.when(bad, F.concat(F.lit("feed fetch failed ("), F.coalesce(F.col("feed_status").cast("string"), F.lit("no answer")), F.lit(")")))})

    def own_transcript(rows: DataFrame) -> DataFrame:
        return answers["feed_transcript"](rows.withColumn("media", best)).withColumn("kind", F.when(F.trim("value") != "", "feed_transcript"))

    items = F.regexp_extract_all(F.col("feed"), F.lit(r"(?is)<item\b.*?</item>"), F.lit(0))
    title_of = lambda i: payloads.loose_title(F.regexp_replace(F.regexp_extract(i, r"(?is)<title>(.*?)</title>", 1), r"(?i)<!\[CDATA\[|\]\]>", ""))
    best = payloads.preferred_transcript(F.flatten(F.transform(F.filter(items, lambda i: title_of(i) == payloads.loose_title(F.col("episode"))), payloads.transcript_candidates)))["url"]
    searched = lambda rows: answers["search"](rows.withColumn("media", none))
    enclosure = item["url"]
    fail = lambda note: lambda rows: rows.withColumns({"settled": F.lit(True), "note": F.lit(note)})
    steps = [
        Step("embed", learned, quiet=True),
        Step("embedded_sound", transcribed(F.col("audio"), "embedded_sound", preview=True), F.col("audio").isNotNull() & ~V.is_encrypted(F.col("drm"))),
        Step("directory", answers["directory"], quiet=True),
        Step("search", searched, F.col("feed_url").isNull(), quiet=True),
        Step("searched_episode", transcribed(F.col("media"), "searched_episode", final="no feed found for the show"), F.col("feed_url").isNull() & F.col("media").isNotNull()),
        Step("no_feed", fail("no feed found for the show"), F.col("feed_url").isNull(), quiet=True),
        Step("feed", fed, quiet=True),
        Step("feed_transcript", own_transcript, F.col("feed").rlike("(?i)podcast:transcript") & best.isNotNull()),
        Step("enclosure", transcribed(enclosure, "enclosure", final="transcription of the enclosure failed"), enclosure.isNotNull()),
        Step("search_again", searched, quiet=True),
        Step("searched_later", transcribed(F.col("media"), "searched_episode", final="episode not found in the feed"), F.col("media").isNotNull()),
        Step("no_episode", fail("episode not found in the feed"), quiet=True),
    ]
    return steps


def parts_of(media: DataFrame, key: str, payload: str, size: int) -> DataFrame:
    """(key, part, parts, payload) of media cut into parts of ``size`` characters or
    bytes; one without any has none."""
    length = F.length(payload)
    rows = media.where(length > 0).withColumn("parts", F.ceil(length / size).cast("int"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select(key, "part", "parts", F.substring(payload, F.col("part") * size + 1, F.lit(size)).alias(payload))


def chunked(media: DataFrame, key: str, payload: str, size: int, tries: list[Service]) -> DataFrame:
    """(key, parts, done, text, error, notes) of media that are transcribed in parts.

    Every part is asked for on its own, those that failed again by the next of
    ``tries`` (a service adds value and, where it fails, failure; a part may have
    nothing to say). A medium's parts are joined in order with a blank line; its first
    part that failed to the end cuts it off: it has that part's error and no text,
    and ``done`` counts the parts before. Media without a payload have the error
    ``no parts``. Keys are unique."""
    parts = parts_of(media, key, payload, size)
    none = F.lit(None).cast("string")
    again = lambda s: lambda rows: s(rows.withColumn("failure", none))
    steps = [Step(f"try{i + 1}", again(s), None if i == 0 else F.col("failure").isNotNull()) for i, s in enumerate(tries)]
    said = resolve(parts, steps, {"failure": "string"}).drop(payload)
    bad = F.col("value").isNull() & F.col("failure").isNotNull()
    whole = said.groupBy(key).agg(
        F.max("parts").alias("parts"), F.min(F.when(bad, F.struct("part", "failure"))).alias("first_"), F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("part", "value")))).alias("texts_"),
    )
    text = F.when(F.col("first_").isNull(), F.array_join(F.transform("texts_", lambda t: t["value"]), "\n\n"))
    whole = whole.select(F.col(key).alias("k_"), "parts", F.coalesce("first_.part", "parts").alias("done"), text.alias("text_"), F.col("first_.failure").alias("error"))
    rows = media.select(key).join(whole, F.col(key).eqNullSafe(F.col("k_")), "left")
    lacks = F.col("parts").isNull()
    notes = F.when(~lacks, F.concat(F.lit("cut into "), F.col("parts").cast("string"), F.lit(f" parts of {size}")))
    return rows.select(key, F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("done", F.lit(0)).alias("done"), F.col("text_").alias("text"), F.when(lacks, "no parts").otherwise(F.col("error")).alias("error"), notes.alias("notes"))
