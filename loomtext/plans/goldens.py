"""Cases over the rows of ``documents``: every row gives each function inputs made of
its id, some of them null or malformed, and SQL says what must come out.

In the strings of a case ``@n@`` stands for the id, ``@v@`` for eleven characters and
``@w@`` for a word of its hash; ``k`` is the id itself. An expected value is such a string,
SQL over the same names (``q``), or None.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomtext.functions import clock as K, markdown as MD, options as O, payloads as P, scan, services as V, text as T, urls as U
from loomtext.operators import metrics as M, timeline as L


class q(str):  # noqa: N801 - reads as a quotation mark
    """SQL of an expected value."""


_NAMES = re.compile("@([nvw])@")


def s(x: str | None) -> Column:
    """A string of a case."""
    if x is None or not _NAMES.search(x):
        return F.lit(x).cast("string")
    parts = _NAMES.split(x)
    return F.concat(*(F.col(t) if i % 2 else F.lit(t) for i, t in enumerate(parts) if t))


def nums(*x: float | Column) -> Column:
    return F.array(*(v.cast("double") if isinstance(v, Column) else F.lit(float(v)) for v in x)) if x else F.array().cast("array<double>")


def k() -> Column:
    return F.col("k")


def j(x: Column) -> Column:
    return F.to_json(x)


def number(x: Column) -> Column:
    """A double in plain decimals, as SQL writes it; Spark's own cast turns to exponents at ten million."""
    x = x.cast("double")
    plain = F.regexp_replace(x.cast("decimal(30,10)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(x).between(1e7, 1e15), plain).otherwise(x.cast("string"))


def cases_text() -> dict[str, tuple[Column, str | None]]:
    budget = T.content_budget(F.concat(s("@w@ "), s("word. " * 200)), 600)
    return {
        "T-01 invisible": (T.strip_invisible(s("a\u200b@w@\u2060c\ufeff\U000e0041d")), "a@w@cd"),
        "T-01 null": (T.strip_invisible(s(None)), None),
        "T-02 normalize": (T.normalize_for_prompt(s("“@w@”\u00a0\u00a0\"world\t\t\n\n  @n@ \n\n\n line")), "“@w@” \"world\n@n@\nline"),
        "T-04 entities": (T.decode_html_entities(s("&amp;lt; &quot;@w@&#39;&nbsp;@n@")), "< \"@w@' @n@"),
        "T-05 candidate": (T.normalize_candidate(s("  @w@ \n @n@ ")), "@w@ @n@"),
        "T-05 blank": (T.normalize_candidate(s(" \u00a0\n")), None),
        "T-06 sentence": (T.clip_at_sentence(s("@w@ sentence. Second @w@. Third sentence."), 22), "@w@ sentence."),
        "T-06 short": (T.clip_at_sentence(s("@w@ sentence. Second sentence. Third sentence."), 3), q("substr(w, 1, 3)")),
        "T-07 within budget": ((F.length(budget["content"]) <= 600).cast("string"), "true"),
        "T-07 marks": (F.contains(budget["content"], F.lit("middle truncated")).cast("string"), "true"),
        "T-08 counts": (budget["total_characters"].cast("string"), q("(length(w) + 1201)::VARCHAR")),
        "T-09 title": (T.strip_leading_title(s("My @w@\n\nBody @n@"), s("my @w@")), "Body @n@"),
        "T-09 other": (T.strip_leading_title(s("My @w@\n\nBody"), s("your @w@")), "My @w@\n\nBody"),
        "T-10 lines": (T.normalize_transcript_lines(F.array(s(" @w@  a"), s(" "), s("@n@"))), "@w@ a\n@n@"),
        "T-12 xml": (T.decode_xml_entities(s("@w@ &#38; b &apos;@n@&apos;")), "@w@ & b '@n@'"),
        "T-13 loose": (P.loose_title(s("  Éclair: @w@ -- @n@! ")), "eclair @w@ @n@"),
        "T-14 cut": (T.truncate_words(s("@w@ two three four"), 12), q("CASE WHEN length(w) = 6 THEN w || ' two...' END")),
        "T-15 ocr": (T.clean_ocr(s("a\nGood @w@ line\n!!!\naaaaaaaaaaaaaaaaaaaaaaaaa\nok")), "Good @w@ line\nok"),
        "AG-19 confidence": (T.ocr_confidence(s("ab!!@w@@w@")).cast("string"), "0.875"),
        "T-16 intro": (T.intro_paragraph(s("# Head\n\n@w@. Two. @n@. Four.\n\nNext")), "@w@. Two. @n@."),
        "T-18 split": (j(T.split_at_slides(s("Intro @w@\n\n## Slides\n@n@"))), '{"summary":"Intro @w@","slides":"## Slides\\n@n@"}'),
        "T-20 markers": (j(T.slide_markers(s("[slide:0] [slide:2] x [Slide:1@n@]"))), "[2,1@n@]"),
        "T-27 tag": (T.tagged_block(s("<a> @w@\n@n@ </a>"), "a"), "@w@\n@n@"),
        "T-27 no tag": (T.tagged_block(s("@w@"), "a"), None),
        "T-28 slug": (T.slug(s("--Hello, @w@! @n@--")), "hello-@w@-@n@"),
        "T-29 note": (T.append_note(s("@w@"), s("b@n@")), "@w@; b@n@"),
        "T-29 first note": (T.append_note(s(None), s("@w@")), "@w@"),
        "T-36 size": (T.parameter_billions(s("org/model-8b-x70b-1.5b-@w@z")).cast("string"), "70.0"),
        "T-36 none": (T.parameter_billions(s("turbo-@n@")).cast("string"), None),
        "T-37 prefix": (T.sanitize_json_prefix(s(")]}'\n{\"@w@\":@n@}")), '{"@w@":@n@}'),
        "T-38 balanced": (scan.balanced_object_col(s('var x = {"@w@":"}","b":{"c":@n@}}; y'), s("x =")), '{"@w@":"}","b":{"c":@n@}}'),
        "T-38 open": (scan.balanced_object_col(s('var x = {"@w@":"}"'), s("x =")), None),
        "IO-26 dotenv": (j(scan.dotenv_col(s("A=@n@\n# c\nexport B='x @w@'\nC=@w@ # no"))), '{"A":"@n@","B":"x @w@","C":"@w@"}'),
    }


def cases_url() -> dict[str, tuple[Column, str | None]]:
    b = lambda c: c.cast("string")
    return {
        "PF-01 host": (b(U.is_video_host(s("https://m.YouTube.com/@w@"))), "true"),
        "PF-01 text": (b(U.is_video_host(s("see youtu.be @w@ please"))), "true"),
        "PF-01 other": (b(U.is_video_host(s("https://notyoutube.com/@v@"))), "false"),
        "PF-01 null": (b(U.is_video_host(s(None))), "false"),
        "PF-02 watch": (b(U.is_video_page(s("https://www.youtube.com/watch?v=@v@"))), "true"),
        "PF-02 no id": (b(U.is_video_page(s("https://www.youtube.com/watch?v=&x=@n@"))), "false"),
        "PF-02 short": (b(U.is_video_page(s("https://youtube.com/shorts/@v@"))), "true"),
        "PF-03 id": (U.video_id(s("https://youtu.be/@v@?t=@n@")), "@v@"),
        "PF-03 vi": (U.video_id(s("https://www.youtube.com/watch?vi=@v@")), "@v@"),
        "PF-03 nested": (U.video_id(s("https://www.youtube.com/attribution_link?u=%2Fwatch%3Fv%3D@v@%26x%3D1")), "@v@"),
        "PF-03 short": (U.video_id(s("https://www.youtube.com/shorts/@w@")), None),
        "PF-03 long": (U.video_id(s("https://youtu.be/@v@x")), None),
        "PF-03 null": (U.video_id(s(None)), None),
        "PF-04 canonical": (U.canonical_video_url(s("https://www.youtube.com/embed/@v@")), "https://www.youtube.com/watch?v=@v@"),
        "PF-04 other": (U.canonical_video_url(s("https://example.com/@v@")), None),
        "PF-05 media": (b(U.is_direct_media(s("https://a.b/@w@.MP4?x=@n@"))), "true"),
        "PF-05 page": (b(U.is_direct_media(s("https://a.b/@w@.mp4x"))), "false"),
        "PF-05 extension": (b(U.is_media_extension(s(" .Opus"))), "true"),
        "PF-07 podcast": (b(U.is_podcast_host(s("https://open.spotify.com/show/@n@"))), "true"),
        "PF-07 shop": (b(U.is_podcast_host(s("https://music.amazon.de/podcasts/@n@"))), "true"),
        "PF-07 music": (b(U.is_podcast_host(s("https://music.amazon.de/albums/@n@"))), "false"),
        "PF-08 type": (b(U.is_podcast_type(s("@w@PodcastEpisode"))), "true"),
        "PF-08 other": (b(U.is_podcast_type(s("Article@n@"))), "false"),
        "PF-09 episode": (U.spotify_episode_id(s("https://open.spotify.com/episode/4@v@?si=1")), "4@v@"),
        "PF-09 show": (j(U.apple_podcast_ids(s("https://podcasts.apple.com/us/podcast/@w@/id1@n@?i=4@n@"))), '{"show":"1@n@","episode":"4@n@"}'),
        "PF-09 no episode": (U.spotify_episode_id(s("https://open.spotify.com/track/@v@")), None),
        "PF-10 status": (b(U.is_message_status(s("https://www.x.com/@w@/status/1@n@"))), "true"),
        "PF-10 broadcast": (b(U.is_message_broadcast(s("https://twitter.com/i/broadcasts/1@v@"))), "true"),
        "PF-10 profile": (b(U.is_message_status(s("https://x.com/@w@"))), "false"),
        "PF-11 mirrors": (b(F.size(U.mirror_urls(s("https://x.com/@w@/status/1@n@?x=1")))), "5"),
        "PF-11 rest": (b(F.forall(U.mirror_urls(s("https://x.com/@w@/status/1@n@?x=1#@v@")), lambda u: F.endswith(u, s("/@w@/status/1@n@?x=1#@v@")))), "true"),
        "PF-11 hash": (b(U.path_hash(s("/@w@"))), q("list_reduce(list_transform(string_split('/' || w, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 31 + c + 2147483648) % 4294967296 - 2147483648)::VARCHAR")),
        "PF-11 other": (b(F.size(U.mirror_urls(s("https://example.com/@w@")))), "0"),
        "PF-12 blocked": (b(U.is_blocked_message(s("@w@: something went wrong."))), "true"),
        "PF-12 fine": (b(U.is_blocked_message(s("@w@ said it"))), "false"),
        "PF-12 challenge": (b(U.is_challenge_page(s("<p>Anubis @w@</p>"))), "true"),
        "PF-06 url mode": (b(U.prefers_url_mode(s("https://example.com/@w@"))), "false"),
        "PF-06 video": (b(U.prefers_url_mode(s("https://youtu.be/@v@"))), "true"),
        "IO-01 last url": (j(U.input_target(s("see http://a.b/@w@, then (https://d.e/@n@)."))), '{"kind":"url","value":"https://d.e/@n@"}'),
        "IO-01 stdin": (j(U.input_target(s(" - "))), '{"kind":"stdin"}'),
        "IO-01 file": (j(U.input_target(s("file:///tmp/@w@%20b"))), '{"kind":"file","value":"/tmp/@w@ b"}'),
        "IO-01 text": (j(U.input_target(s("@w@ and @n@"))), "{}"),
        "IO-02 repair": (U.repair(s("http://a.b/@w@\\?d\\=@n@%5C&e")), "http://a.b/@w@?d=@n@&e"),
        "IO-03 brackets": (U.trim_punctuation(s("https://a.b/c_(@w@)).")), "https://a.b/c_(@w@)"),
        "IO-03 quotes": (U.trim_punctuation(s("“https://a.b/@n@”;")), "https://a.b/@n@"),
        "IO-04 urls": (j(U.urls_in(s("http://a.b/@n@, 'https://c.d/@w@'"))), '["http://a.b/@n@","https://c.d/@w@"]'),
        "IO-04 none": (j(U.urls_in(s("ftp://@w@"))), "[]"),
        "IO-05 asset": (U.url_kind(s("https://a.b/@w@.pdf"), s(None), s(None), s(None)), "asset"),
        "IO-05 page": (U.url_kind(s("https://a.b/@w@.php"), s("text/html; x"), s(None), s(None)), "website"),
        "IO-05 header": (U.url_kind(s("https://a.b/@w@"), s("image/png"), s(None), s(None)), "asset"),
        "IO-05 attachment": (U.url_kind(s("https://a.b/@w@"), s(None), s("attachment; filename=@w@"), s(None)), "asset"),
        "IO-06 filename": (U.disposition_filename(s("attachment; filename*=UTF-8''@w@%20b.pdf; filename=\"c\"")), "@w@ b.pdf"),
        "IO-06 plain": (U.disposition_filename(s("inline; filename=\"@w@+@n@.txt\"")), "@w@+@n@.txt"),
        "IO-06 none": (U.disposition_filename(s("inline; @w@")), None),
        "IO-07 magic": (U.mime_of(F.encode(s("%PDF-1.7 @w@"), "UTF-8"), s("text/plain"), s("@w@.txt")), "application/pdf"),
        "IO-07 name": (U.mime_of(F.encode(s("@w@"), "UTF-8"), s("application/octet-stream"), s("@w@.CSV")), "text/csv"),
        "IO-07 nothing": (U.mime_of(F.encode(s("@w@"), "UTF-8"), s(None), s("@w@")), "application/octet-stream"),
        "IO-10 text": (b(U.is_text_type(s("text/@w@"))), "true"),
        "IO-10 archive": (b(U.is_archive_type(s("application/zip"))), "true"),
        "IO-10 convertible": (b(U.is_convertible_type(s("application/vnd.openxmlformats-officedocument.@w@"))), "true"),
        "T-40 link": (U.timestamp_link(s("https://youtu.be/@v@"), k() + 0.4), "https://www.youtube.com/watch?v=@v@&t=@n@s"),
        "T-40 other": (U.timestamp_link(s("https://example.com/@w@"), k()), None),
        "X-22 id": (U.message_id(s("https://x.com/@w@/status/9@n@?s=1")), "9@n@"),
        "X-22 digits": (U.message_id(s(" 9@n@ ")), "9@n@"),
        "X-22 none": (U.message_id(s("@w@ 9")), None),
    }


def cases_time() -> dict[str, tuple[Column, str | None]]:
    b = lambda c: c.cast("string")
    x = k().cast("double")
    seg = F.array(F.struct(F.lit(1000).alias("startMs"), s("@w@\n b").alias("text")), F.struct((k() * 1000 + 3_600_000).alias("startMs"), F.lit("c").alias("text")))
    segs = L.scene_segments(nums(x + 4, x + 4.02, x + 10), x + 15)
    clock = "(k // 3600) || ':' || lpad((k // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((k % 60)::VARCHAR, 2, '0')"
    short = "CASE WHEN k < 3600 THEN (k // 60) || ':' || lpad((k % 60)::VARCHAR, 2, '0') ELSE {} END"
    return {
        "D-01 ms": (K.format_ms(k() * 1000 + 499), q(short.format(clock))),
        "D-02 seconds": (K.format_seconds(k() + 0.9), q(short.format("lpad((k // 3600)::VARCHAR, 2, '0') || substr(" + clock + ", instr(" + clock + ", ':'))"))),
        "D-03 clock": (b(K.parse_clock_ms(F.concat(s("0@n@:02:03,5")))), q("(k * 3600000 + 123500)::VARCHAR")),
        "D-03 seconds": (b(K.parse_clock_ms(s(" @n@.25 "))), q("(k * 1000 + 250)::VARCHAR")),
        "D-03 bad": (b(K.parse_clock_ms(s("@n@:2:3:4"))), None),
        "D-03 word": (b(K.parse_clock_ms(s("@w@"))), None),
        "D-03 null": (b(K.parse_clock_ms(s(None))), None),
        "D-04 ms": (b(K.parse_time_ms(s("@n@"))), "@n@"),
        "D-04 seconds": (b(K.parse_time_ms(s("@n@.5"), True)), q("(k * 1000 + 500)::VARCHAR")),
        "D-05 seconds": (number(K.parse_seconds(s("@n@:00:05"))), q("((k * 3600 + 5)::DOUBLE)::VARCHAR")),
        "D-06 timed": (K.timed_text(seg), q("'[0:01] ' || w || ' b' || chr(10) || '[' || ((k + 3600) // 3600) || ':' || lpad(((k + 3600) // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((k % 60)::VARCHAR, 2, '0') || '] c'")),
        "D-07 parse": (j(K.parse_timed_text(s("[0:09] @w@\nx\n[0:01] a@n@"))), '[{"at":1.0,"text":"a@n@"},{"at":9.0,"text":"@w@"}]'),
        "D-10 round": (b(K.round_threshold(k() * 0 + 0.125)), "0.13"),
        "D-12 segments": (b(F.size(L.split_segments(x, 3))), q("greatest(1, least(3, ceil(k / 60)))::INT::VARCHAR")),
        "D-12 interval": (number(L.interval_times(x, 12, 3)["interval"]), q("CASE WHEN k > 0 THEN (CASE WHEN k / 3 > 12 THEN k / 3 ELSE 12 END)::DOUBLE::VARCHAR END")),
        "D-13 samples": (b(F.size(L.calibration_times(x, 8))), q("CASE WHEN k > 0 THEN '8' ELSE '1' END")),
        "D-14 hash": (j(K.average_hash(F.array(k() + 1, k() + 2, k() + 3, k() + 6))), "[0,0,1,1]"),
        "D-14 distance": (b(K.hash_distance(nums(k() % 2, 0, 1, 1), nums(1, 1, 1, 0))), q("CASE WHEN k % 2 = 1 THEN '0.5' ELSE '0.75' END")),
        "D-15 threshold": (j(L.scene_threshold(L.diff_stats(nums(0.1, 0.2, 0.3)), (k() * 0 + 3))), '{"threshold":0.05,"confidence":1.0}'),
        "D-16 adjust": (number(L.adjusted(x, x, x + 10)), q("(k + 0.8)::DOUBLE::VARCHAR")),
        "D-16 extracted": (number(L.extracted_time(x + 20, F.lit(1.5), x + 19)), q("CASE WHEN k <= 0 THEN '20.5' ELSE (k + 20.5)::DOUBLE::VARCHAR END")),
        "D-19 tokens": (b(K.completion_tokens(k())), q("greatest(256, ceil(k / 4))::BIGINT::VARCHAR")),
        "D-20 words": (b(K.words_from_chars(k() * 6)), "@n@"),
        "D-20 minutes": (b(K.minutes_from_words(k() * 160 + 161)), q("(k + 2)::VARCHAR")),
        "D-21 delay": (b(K.retry_delay_ms((k() % 5).cast("int"), F.lit(7))), q("least(2000, 500 * (k % 5 + 1) + 7)::BIGINT::VARCHAR")),
        "D-23 percent": (b(K.progress_percent(x, x * 3)), q("CASE WHEN k > 0 THEN '33' END")),
        "W-05 gap": (j(L.min_duration(nums(5, 1, 1.4, 4), 1.5)), "[1.0,4.0]"),
        "W-06 merge": (j(F.transform(L.merged(nums(x + 1, x + 5), nums(x + 1.2, x + 10), 2), lambda t: (t - x).cast("int"))), "[1,5,10]"),
        "W-07 segments": (j(F.transform(segs, lambda g: F.round((g["end"] - g["start"]) * 1).cast("int"))), q("'[' || (k + 4) || ',6,5]'")),
        "J-13 segment": (b((L.segment_at(segs, x + 4.5)["end"] - x).cast("int")), "10"),
        "J-13 last": (b((L.segment_at(segs, x + 99)["start"] - x).cast("int")), "10"),
        "J-12 targets": (j(F.transform(L.target_times(nums(x + 5, x + 20, x + 40), nums(x + 4.5, x + 18.5, x + 39, x + 39.2), 5, 15), lambda t: (t - x) * 2)), "[9.0,37.0,78.0]"),
        "W-09 split": (j(L.even_split(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: i + k()), 3)), q("'[[' || (k+1) || ',' || (k+2) || '],[' || (k+3) || ',' || (k+4) || ',' || (k+5) || '],[' || (k+6) || ',' || (k+7) || ']]'")),
        "J-11 interleave": (L.interleaved(s("[0:01] @w@\n[0:09] b"), F.array(F.struct(F.lit(5.0).alias("at"), F.lit(1).alias("index")), F.struct(F.lit(20.0).alias("at"), F.lit(2).alias("index")))), "[0:01] @w@\n[slide:1]\n[0:09] b\n[slide:2]"),
        "J-10 prompt": (L.slide_prompt(F.array(F.struct(F.lit(10.0).alias("at"), F.lit(1).alias("index"))), F.array(F.struct(F.lit(12.0).alias("at"), s("@w@").alias("text"))), 500), "[slide:1] [0:00–0:50]\n@w@"),
        "AG-13 last": (b(L.last_time(F.array(F.struct(F.lit(1000).alias("startMs"), F.lit(9500).alias("endMs"))), s("[0:11] @w@"), F.lit(10.5))), "11"),
        "AG-10 middle": (number(M.middle(nums(x + 4, x + 1, x + 3, x + 2))), q("(k + 2.5)::DOUBLE::VARCHAR")),
        "AG-10 upper": (number(M.upper_middle(nums(x + 4, x + 1, x + 3, x + 2))), q("(k + 3)::DOUBLE::VARCHAR")),
        "T-30 elapsed": (K.elapsed(k() * 60_000 + 184_000), q("CASE WHEN k + 3 < 60 THEN (k + 3) || 'm 4s' ELSE ((k + 3) // 60) || 'h ' || ((k + 3) % 60) || 'm 4s' END")),
        "T-30 bytes": (K.byte_size(k() % 1024), q("(k % 1024) || ' B'")),
        "T-30 count": (K.compact_count(k() % 1000), q("(k % 1000)::VARCHAR")),
        "X-16 label": (K.byte_label(k() * 0 + 1536), "1.5KB"),
        "T-30 usd": (K.usd(k() * 0 + 0.0123), "$0.0123"),
    }


def cases_payload() -> dict[str, tuple[Column, str | None]]:
    feed = "<rss><item><title><![CDATA[One @w@]]></title><enclosure url='http://a/@n@.mp3'/><itunes:duration>1:02</itunes:duration><podcast:transcript url='http://a/t.vtt' type='text/vtt'/><podcast:transcript url='http://a/@v@.json'/></item><item><title>Twô @w@</title><enclosure url=\"http://a/2@n@.mp3\"/></item></rss>"
    vtt = "WEBVTT\n\nNOTE x\n\n1\n00:01.000 --> 00:02.500 align:left\nHello\n@w@\n\nbad --> 00:03.000\nno\n\n00:00:04,000 --> x\nEnd @n@"
    tracks = F.from_json(s('[{"language":"de","kind":"","url":"1"},{"language":"en","kind":"asr","url":"2"},{"language":"EN","kind":"","url":"@w@"},{"language":"en","kind":"","url":"@n@"}]'), "array<struct<language:string,kind:string,url:string>>")
    none = F.array().cast("array<struct<language:string,kind:string,url:string>>")
    progress = P.download_progress(s("progress:1@n@|NA|40"))
    sums = F.create_map(s("a"), s('{"prompt":@n@,"total":0}'), s("b"), s('{"prompt":2,"completion":4}'))
    b = lambda c: c.cast("string")
    return {
        "H-26 anthropic": (j(P.usage(s('{"input_tokens":@n@,"output_tokens":4}'), "anthropic")), q("""'{"prompt":' || n || ',"completion":4,"total":' || (k + 4) || '}'""")),
        "H-26 google": (j(P.usage(s('{"promptTokenCount":1,"totalTokenCount":9@n@}'), "google")), '{"prompt":1,"total":9@n@}'),
        "H-26 plain": (j(P.usage(s('{"input":"@w@"}'), "plain")), None),
        "AG-05 models": (j(P.model_sums(sums)), q("""'{"prompt":' || (k + 2) || ',"completion":4,"total":' || (CASE WHEN k = 0 THEN 6 ELSE k + 6 END) || '}'""")),
        "AG-06 jsonl": (j(P.jsonl_usage(s('@w@\n{"usage":{"input_tokens":@n@},"cost_usd":0.5}\n{"usage":{"input_tokens":2,"output_tokens":3},"cost_usd":0.7}'))), '{"prompt":2,"completion":3,"cost":0.5}'),
        "H-27 result": (P.result_text(s('log\n{"result":" ","response":"@w@ @n@"}')), "@w@ @n@"),
        "X-11 duration": (number(P.duration_line(s('x\n{"duration":0}\n{"duration":1@n@.5}'))), q("(('1' || n || '.5')::DOUBLE)::VARCHAR")),
        "X-10 progress": (j(progress.withField("done", progress["done"].cast("decimal(20,1)"))), q("""'{"done":' || (('1' || n)::DOUBLE)::VARCHAR || ',"total":40.0}'""")),
        "H-21 vtt": (j(P.vtt_segments(s(vtt))), '[{"startMs":1000,"endMs":2500,"text":"Hello @w@"},{"startMs":4000,"text":"End @n@"}]'),
        "H-21 text": (P.vtt_text(s("WEBVTT\n\nplain @w@\n12\nwords")), "plain @w@\nwords"),
        "H-21 null": (P.vtt_text(s(None)), None),
        "H-22 json": (j(P.json_segments(s('[{"text":" @w@ ","startMs":@n@},{"utf8":"b","start":"1.5","end":2},{"text":"c"}]'))), q("""CASE WHEN k <= 1500 THEN '[{"startMs":' || n || ',"text":"' || w || '"},{"startMs":1500,"endMs":2000,"text":"b"}]' ELSE '[{"startMs":' || n || ',"text":"' || w || '"},{"startMs":1500,"endMs":2000,"text":"b"}]' END""")),
        "H-22 text": (P.json_transcript_text(s('{"transcript":" @w@ "}')), "@w@"),
        "H-22 bad": (P.json_transcript_text(s("{@w@")), None),
        "H-23 events": (j(P.timed_events(s('{"events":[{"tStartMs":@n@,"dDurationMs":5,"segs":[{"utf8":"a"},{"utf8":"@w@ "}]},{"tStartMs":1}]}'))), q("""'[{"startMs":' || n || ',"endMs":' || (k + 5) || ',"text":"a' || w || '"}]'""")),
        "H-24 xml": (j(P.xml_captions(s("<text start='@n@.5' dur=\"2\">@w@ &amp; b</text><text>c</text>"))), q("""'[{"startMs":' || (k * 1000 + 500) || ',"endMs":' || (k * 1000 + 2500) || ',"text":"' || w || ' & b"}]'""")),
        "W-11 tracks": (F.array_join(F.transform(P.caption_tracks(tracks, none), lambda x: x["url"]), ","), "@n@,1"),
        "PF-18 feed": (b(P.is_feed(s("<?xml?><feed>@w@"))), "true"),
        "PF-18 page": (b(P.is_feed(s("<html>@w@"))), "false"),
        "H-19 items": (j(P.feed_items(s(feed))), '[{"title":"One @w@","url":"http://a/@n@.mp3","seconds":62},{"title":"Twô @w@","url":"http://a/2@n@.mp3"}]'),
        "J-04 episode": (P.episode_of(s(feed), s("TWO @w@!"))["url"], "http://a/2@n@.mp3"),
        "J-04 none": (P.episode_of(s(feed), s("three @w@"))["url"], None),
        "SL-10 transcript": (P.preferred_transcript(P.transcript_candidates(s(feed)))["url"], "http://a/@v@.json"),
        "H-28 text": (P.message_text(s('{"data":{"text":"@w@","note_tweet":{"text":"a longer @w@"}}}')), "a longer @w@"),
        "J-07 author": (j(P.message_author(s('{"data":{"author_id":"2"},"includes":{"users":[{"id":"1","name":"A"},{"id":"2","name":"@w@","username":"u@n@"}]}}'))), '{"name":"@w@","username":"u@n@"}'),
        "H-28 variant": (P.best_variant(F.from_json(s('[{"content_type":"video/mp4","bit_rate":1,"url":"a"},{"content_type":"video/mp4","bit_rate":9@n@,"url":"@w@"},{"content_type":"application/x","url":"c"}]'), "array<struct<content_type:string,bit_rate:long,url:string>>")), "@w@"),
        "H-30 probe": (j(P.probe(s('{"streams":[{"codec_type":"audio","duration":"9"},{"codec_type":"video","duration":"12.5","width":64@n@,"height":360}],"format":{"duration":"13"}}'))), '{"seconds":12.5,"width":64@n@,"height":360}'),
        "H-29 time": (number(P.showinfo_time(s("[Parsed_showinfo] n:1 pts_time:@n@.5 @w@"))), q("((n || '.5')::DOUBLE)::VARCHAR")),
        "PF-14 age": (P.availability(s("<p>@w@"), s("LOGIN_REQUIRED"), s("Sign in to confirm your age, @w@")), "age_restricted"),
        "PF-14 bot": (P.availability(s("Unusual traffic @n@"), s("OK"), s(None)), "bot_check"),
        "PF-14 fine": (P.availability(s("<p>@w@"), s("OK"), s(None)), None),
        "ST-08 parse": (j(P.parse_sse(P.sse_event(s("chunk"), s('{"text":"@w@"}')))), '{"event":"chunk","data":"{\\"text\\":\\"@w@\\"}"}'),
        "ST-08 unknown": (j(P.parse_sse(P.sse_event(s("@w@"), s("{}")))), None),
        "PF-26 failure": (M.failure_kind(s("Rate limit exceeded: free-models-per-day @n@")), "rate_limit_day"),
        "PF-25 retry": (b(M.is_retryable(s("request @w@ Timed out"))), "true"),
        "PF-25 other": (b(M.is_retryable(s("request @w@ denied"))), "false"),
    }


def cases_option() -> dict[str, tuple[Column, str | None]]:
    b = lambda c: c.cast("string")
    return {
        "T-34 duration": (b(O.duration_ms(s("1@n@m"))), q("(('1' || n)::BIGINT * 60000)::VARCHAR")),
        "T-34 bad": (b(O.duration_ms(s("@w@"))), None),
        "T-34 null": (b(O.duration_ms(s(None))), None),
        "T-34 length": (j(O.length(s("20k"))), '{"kind":"chars","chars":20000}'),
        "T-34 preset": (j(O.length(s("M"))), '{"kind":"preset","preset":"medium"}'),
        "T-34 count": (b(O.count(s("1@n@k"), 16)), q("(('1' || n)::BIGINT * 1000)::VARCHAR")),
        "T-34 retries": (b(O.retries(s("9@n@"))), None),
        "T-34 mode": (O.mode(s(" MD "), "format"), "markdown"),
        "T-35 boolean": (b(O.boolean(s("Yes"))), "true"),
        "D-19 preset": (O.preset_for(k() * 0 + 2500), "medium"),
        "T-33 alias": (j(O.language(s("German"))), '{"kind":"fixed","tag":"de","label":"German"}'),
        "T-33 tag": (j(O.language(s("EN_us"))), '{"kind":"fixed","tag":"en-US","label":"en-US"}'),
        "T-33 free": (j(O.language(s("old  @w@ please"))), '{"kind":"fixed","tag":"old @w@ please","label":"old @w@ please"}'),
        "T-33 auto": (j(O.language(s("auto"))), '{"kind":"auto"}'),
        "T-32 infer": (O.model_id(s("gemini-@n@-flash")), "google/gemini-@n@-flash"),
        "T-32 alias": (O.model_id(s("claude-sonnet-4")), "anthropic/claude-sonnet-4-0"),
        "T-32 unknown": (O.model_id(s("acme/@w@")), None),
        "PF-23 key": (O.required_key(s("xai/grok-@n@")), "XAI_API_KEY"),
        "X-20 tier": (O.tier(s("fast")), "priority"),
        "X-20 default": (O.tier(s("default")), None),
        "M-13 merge": (O.merged(s("@w@"), s("@n@"), s(None)), "@n@"),
        "T-26 instructions": (O.instructions(s(" @w@ "), s(""), F.array(s("must @n@"), s(" ")), s(None), s("lang")), "@w@\nmust @n@\nlang"),
        "T-23 links": (MD.spelled_links_col(s("see [@w@](http://b/@n@) ![i](c)\n```\n[a](b)\n```")), "see @w@: http://b/@n@ ![i](c)\n```\n[a](b)\n```"),
        "T-23 blanks": (MD.single_blanks_col(s("@w@\n\n\n\n@n@")), "@w@\n\n@n@"),
        "T-24 references": (MD.inlined_references_col(s("x [@w@][] y\n[@w@]: http://u/@n@\n[b]: http://v")), "x [@w@](http://u/@n@) y\n[b]: http://v"),
        "T-25 moments": (MD.sound_moments_col(s("# @w@\n\n## Key moments\n- 0:10 a\n- 9:00 b\n\n## End\n@n@"), F.lit(60)), "# @w@\n\n## Key moments\n- 0:10 a\n## End\n@n@"),
        "T-25 none left": (MD.sound_moments_col(s("Key moments\n- 9:00 @w@"), F.lit(60)), ""),
        "T-19 slides": (j(MD.slide_summaries_col(s("Intro\n[slide:1] @w@\ntext\n[slide:2]\n@n@"))), '{"1":"@w@\\ntext","2":"@n@"}'),
        "T-17 headline": (MD.headline_col(s("**Big** @w@ today. More.")), "Big @w@ today"),
        "T-21 headings": (MD.plain_slide_headings_col(s("### Slide 3 · @w@\n@n@")), "[slide:3]\n@w@\n@n@"),
    }


def cases_service() -> dict[str, tuple[Column, str | None]]:
    b = lambda c: c.cast("string")
    player = 'x ytInitialPlayerResponse = {"videoDetails":{"title":"@w@","lengthSeconds":"6@n@"},"captions":{"playerCaptionsTracklistRenderer":{"captionTracks":[{"languageCode":"en","baseUrl":"@v@"}]}},"playabilityStatus":{"status":"ERROR","errorScreen":{"playerErrorMessageRenderer":{"reason":{"runs":[{"text":"Not"},{"text":"@w@"}]}}}}};'
    facts = V.player_facts(V.player_response(s(player)))
    panel = '{"actions":[{"updateEngagementPanelAction":{"content":{"transcriptRenderer":{"content":{"transcriptSearchPanelRenderer":{"body":{"transcriptSegmentListRenderer":{"initialSegments":[{"transcriptSegmentRenderer":{"startMs":"5","endMs":"9@n@","snippet":{"runs":[{"text":"@w@ "},{"text":"b"}]}}}]}}}}}}}}]}'
    embed = '<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"state":{"data":{"entity":{"subtitle":"S @w@","title":"E@n@","duration":1500},"defaultAudioFileObject":{"format":"MP4_128_CBCS"}}}}}}</script>'
    return {
        "IO-12 attach": (V.document_handling(s("file"), F.lit(False), k() * 0 + 10, s("auto"), F.lit(True), s("google")), "attach"),
        "IO-12 off": (V.document_handling(s("file"), F.lit(False), k() * 0 + 10, s("off"), F.lit(True), s("xai")), "error"),
        "IO-12 inline": (V.document_handling(s("image"), F.lit(False), k() * 0 + 10, s("off"), F.lit(True), s("xai")), "inline"),
        "IO-18 markdown": (V.scraped_markdown(s('{"data":{"markdown":" ","content":"@w@ @n@"}}')), "@w@ @n@"),
        "IO-18 bad": (V.scraped_markdown(s('{"data":{"markdown":"@w@')), None),
        "H-09 metadata": (j(V.scraped_metadata(s('{"metadata":{"ogTitle":" @w@ ","description":"d@n@"}}'))), '{"title":"@w@","description":"d@n@"}'),
        "PF-24 stream": (b(V.can_stream(s("openai"), s("native"), F.array(s("document")))), "false"),
        "PF-24 unsupported": (b(V.streaming_unsupported(s("@w@: streamGenerateContent is not supported"), s(None))), "true"),
        "X-18 video": (b(V.capability(s("google"), "video")), "true"),
        "X-19 alias": (b(V.has_key(s("GEMINI_API_KEY"), F.array(s("@w@"), s("GOOGLE_API_KEY")))), "true"),
        "X-19 none": (b(V.has_key(s("GEMINI_API_KEY"), F.array(s("@w@")))), "false"),
        "X-13 name": (V.audio_name(s(" @w@ "), s("audio/WAV; x")), "@w@.wav"),
        "X-14 length": (b(V.content_length(s("1@n@.7"))), "1@n@"),
        "X-14 bad length": (b(V.content_length(s("@w@z"))), None),
        "X-14 name": (V.url_filename(s("https://a.b/c/@w@.mp3?x")), "@w@.mp3"),
        "X-12 text": (j(V.candidate_text(s('{"candidates":[{"content":{"parts":[{"text":"@w@"},{"text":"@n@"}]}}]}'))), '{"text":"@w@@n@"}'),
        "X-12 stopped": (j(V.candidate_text(s('{"candidates":[{"finishReason":"@w@"}]}'))), '{"stopped":"@w@"}'),
        "X-02 ids": (j(V.model_ids(s('{"data":[{"id":"x@n@"},{"id":" a@w@ "},{"id":"x@n@"},{}]}'))), '["a@w@","x@n@"]'),
        "X-03 request": (V.request_body(s('{"url":"ftp://@w@","mode":"PAGE","maxCharacters":5}'))["problem"], "missing url"),
        "X-03 mode": (V.request_body(s('{"url":"http://@w@","mode":"PAGE","text":"t","maxExtractCharacters":5}'))["mode"], "page"),
        "X-03 url": (V.request_body(s('{"url":"http://@w@/@n@"}'))["url"], "http://@w@/@n@"),
        "H-15 player": (j(facts.withField("seconds", facts["seconds"].cast("decimal(20,1)"))), q("""'{"title":"' || w || '","seconds":' || (('6' || n)::DOUBLE)::VARCHAR || ',"tracks":[{"language":"en","kind":"","url":"' || v || '"}]}'""")),
        "H-16 reason": (V.playability_reason(V.player_response(s(player))), "Not @w@"),
        "H-17 embed": (j(V.podcast_embed(s(embed))), '{"show":"S @w@","episode":"E@n@","seconds":1.5,"format":"MP4_128_CBCS"}'),
        "H-17 none": (j(V.podcast_embed(s("<p>@w@"))), None),
        "H-18 title": (V.apple_title(s("<meta name='apple:title' content='One @w@'>")), "One @w@"),
        "H-18 url": (V.embedded_url(s('{"streamUrl":"http:\\/\\/a\\/@w@"}'), "streamUrl"), "http://a/@w@"),
        "H-25 panel": (j(V.panel_segments(s(panel))), '[{"startMs":5,"endMs":9@n@,"text":"@w@ b"}]'),
        "X-07 preview": (b(V.looks_like_preview(k() * 0 + 500, k() + 600)), "true"),
        "X-07 short": (b(V.looks_like_preview(k() * 0 + 500, k() % 600)), "false"),
        "X-08 encrypted": (b(V.is_encrypted(s("MP4_@n@_CBCS"))), "true"),
        "T-39 tokens": (b(T.token_estimate(V.clipped_to_tokens(F.concat(s("@w@ "), s("word. " * 900)), 300)) <= 300), "true"),
        "SL-14 front": (j(V.moved_to_front(F.array(s("a"), s("@w@"), s("c")), s("@w@"))), '["@w@","a","c"]'),
        "X-17 label": (V.chain_label(F.array(s("@w@"), s("local"))), "@w@->local"),
        "X-21 bands": (V.bands_problem(k() + 5, k() + 2), "bounds out of order"),
        "X-21 fine": (V.bands_problem(k(), k() + 2), None),
        "T-31 finish": (V.finish_line(s("1.2s"), s("@w@"), k() * 0 + 1200, s(None)), "1.2s · 1,200 words · @w@"),
    }


def _golden(cases) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").select("doc_id", F.abs("doc_id").alias("k"))
        n = F.col("k").cast("string")
        rows = ids.withColumns({"n": n, "v": F.substring(F.md5(n), 1, 11), "w": F.concat(F.lit("w"), F.substring(F.md5(n), 12, 5))})
        # one case at a time, so that no generated method has to hold them all
        out = None
        for name, (got, _) in cases().items():
            part = rows.select("doc_id", F.lit(name).alias("case"), got.alias("value"))
            out = part if out is None else out.union(part)
        return out

    return run


class _Literals:
    """A stand-in for columns, so that expected values can be read without a session."""

    def __getattr__(self, name):
        return self

    def __call__(self, *args, **kwargs):
        return self

    __getitem__ = __le__ = __add__ = __radd__ = __sub__ = __mul__ = __mod__ = __call__


def _sql(cases) -> str:
    names = ("F", "K", "MD", "O", "P", "scan", "T", "U", "V", "M", "L", "s", "nums", "number", "j", "k")
    own = {n: globals()[n] for n in names}
    globals().update(dict.fromkeys(names, _Literals()))
    try:
        rows = [(n, v) for n, (_, v) in cases().items()]
    finally:
        globals().update(own)
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def value(x: str | None) -> str:
        if x is None or isinstance(x, q):
            return "NULL::VARCHAR" if x is None else f"({x})"
        parts = _NAMES.split(x)
        return " || ".join(t if i % 2 else quote(t) for i, t in enumerate(parts) if t) or "''"

    rows_sql = ", ".join(f"{{'case': {quote(n)}, 'value': {value(v)}}}" for n, v in rows)
    ids = "SELECT doc_id, abs(doc_id) AS k, abs(doc_id)::VARCHAR AS n, substr(md5(abs(doc_id)::VARCHAR), 1, 11) AS v, 'w' || substr(md5(abs(doc_id)::VARCHAR), 12, 5) AS w FROM documents WHERE doc_id IS NOT NULL"
    return f"""SELECT doc_id, r."case" AS "case", r.value AS value FROM (SELECT doc_id, unnest([{rows_sql}]) AS r FROM ({ids}))"""


GOLDENS = {f.__name__.replace("cases_", "golden_"): (_golden(f), _sql(f)) for f in (cases_text, cases_url, cases_time, cases_payload, cases_option, cases_service)}
