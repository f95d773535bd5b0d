"""Registered queries of service chains. Services are made of the tables, so that
SQL can say what every chain must answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtext.functions import tokens
from loomtext.operators.chains import Service, ledger, resolve
from loomtext.plans import fetching, transcripts
from loomtext.plans.registry import query


def every(key: Column, n: int, value: Column | str) -> Column:
    """``value`` where ``key`` is divisible by ``n``, else null."""
    return F.when(key % n == 0, F.lit(value) if isinstance(value, str) else value)


def answering(**columns: Column) -> Service:
    return lambda rows: rows.withColumns(columns)


# fetching pages

def _page_fetch(identity: bool) -> Service:
    k = F.col("page_id")
    broken = every(k, 13, "ZlibError: incorrect data check") if not identity else every(k, 26, "ShortRead")
    failure = F.coalesce(broken, every(k, 17, "The operation was aborted."), every(k, 19, "connection refused"))
    kind = F.coalesce(every(k, 11, "application/pdf"), every(k, 5, "TEXT/HTML; charset=utf-8"), every(k, 3, "application/rss+xml"))
    status = F.when(failure.isNull(), F.coalesce(every(k, 7, F.lit(503)), every(k, 23, F.lit(204)), F.lit(200)))
    return answering(failure=failure, status=status, content_type=kind, final_url=every(k, 2, F.concat("url", F.lit("#final"))), body=F.when(failure.isNull(), F.when(k % 29 == 0, "Attention Required! Please solve the captcha").otherwise(F.col("html"))))


def page_fetches(pages: DataFrame) -> DataFrame:
    k = F.col("page_id")
    scrapers = {"exa": answering(body=every(k, 2, "  ")), "cloudflare": answering(failure=every(k, 3, "status 500"), body=every(k, 3, "lost")), "firecrawl": answering(body=F.when(k % 5 > 0, F.concat(F.lit("# "), "url")))}
    return fetching.fetched(pages, _page_fetch, scrapers)


_S_FETCH = """WITH f AS (SELECT *, CASE WHEN page_id % 13 = 0 THEN 'ZlibError: incorrect data check' WHEN page_id % 17 = 0 THEN 'timed out' WHEN page_id % 19 = 0 THEN 'connection refused' WHEN page_id % 7 = 0 THEN 'status 503' WHEN page_id % 11 = 0 THEN 'content type application/pdf' END AS p1 FROM pages),
g AS (SELECT *, p1 LIKE 'Zlib%' AS again, CASE WHEN p1 LIKE 'Zlib%' THEN CASE WHEN page_id % 26 = 0 THEN 'ShortRead' WHEN page_id % 17 = 0 THEN 'timed out' WHEN page_id % 19 = 0 THEN 'connection refused' WHEN page_id % 7 = 0 THEN 'status 503' WHEN page_id % 11 = 0 THEN 'content type application/pdf' END ELSE p1 END AS p2 FROM f),
h AS (SELECT *, p2 IS NULL AND page_id % 29 > 0 AS page, page_id % 5 > 0 AS scraped FROM g) """


@query(_S_FETCH + """SELECT page_id, CASE WHEN page THEN CASE WHEN again THEN 'identity' ELSE 'compressed' END WHEN scraped THEN 'firecrawl' END AS provider, p2 AS problem,
sha256(CASE WHEN page THEN html WHEN scraped THEN '# ' || url END) AS digest, CASE WHEN page_id % 2 = 0 THEN url || '#final' ELSE url END AS final_url, concat_ws('|', p1, CASE WHEN again THEN p2 END) AS notes,
'compressed' || CASE WHEN again THEN '|identity' ELSE '' END || CASE WHEN page THEN '' ELSE '|exa|cloudflare|firecrawl' END AS attempted FROM h""")
def fetch_chain(t):
    out = page_fetches(t("pages"))
    return out.select("page_id", "provider", "problem", F.sha2("value", 256).alias("digest"), "final_url", F.array_join("notes", "|").alias("notes"), F.array_join("attempted", "|").alias("attempted"))


@query(_S_FETCH + """SELECT 'compressed' AS step, count(*) AS asked, count(*) FILTER (page AND NOT coalesce(again, false)) AS resolved FROM h
UNION ALL SELECT 'identity', count(*) FILTER (again), count(*) FILTER (page AND again) FROM h HAVING count(*) FILTER (again) > 0
UNION ALL SELECT s, count(*), count(*) FILTER (scraped AND s = 'firecrawl') FROM h, (VALUES ('exa'), ('cloudflare'), ('firecrawl')) AS v(s) WHERE NOT page GROUP BY s""")
def fetch_ledger(t):
    return ledger(page_fetches(t("pages")))


# videos, by mode

def video_transcripts_of(docs: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    rows = docs.select("doc_id", "text", F.element_at(F.array(*map(F.lit, ("auto", "web", "no-auto", "yt-dlp", "apify"))), (k % 5 + 1).cast("int")).alias("mode"), F.when(k % 19 > 0, "<html>").alias("page"), (k % 4 > 0).alias("can"), (k % 3 > 0).alias("token"))
    answers = {"manual": answering(value=every(k, 2, F.col("text"))), "captions": answering(value=every(k, 7, F.col("text"))), "download": answering(value=F.when(k % 6 > 2, F.concat(F.lit("heard "), "text")).otherwise(" ")), "apify": answering(value=every(k, 11, F.concat(F.lit("scraped "), "text")))}
    return resolve(rows, transcripts.video_steps(answers, F.col("mode"), F.col("page"), F.col("can"), F.col("token")))


@query("""WITH r AS (SELECT *, (['auto', 'web', 'no-auto', 'yt-dlp', 'apify'])[doc_id % 5 + 1] AS mode, doc_id % 19 > 0 AS page, doc_id % 4 > 0 AS can, doc_id % 3 > 0 AS token FROM documents),
a AS (SELECT *, CASE WHEN mode <> 'apify' AND NOT page THEN 'no page' WHEN mode = 'yt-dlp' AND NOT can THEN 'no downloader' WHEN mode = 'apify' AND NOT token THEN 'no scraper token' END AS stop,
CASE mode WHEN 'auto' THEN ['captions'] || CASE WHEN can THEN ['download'] ELSE [] END || CASE WHEN token THEN ['apify'] ELSE [] END WHEN 'web' THEN ['captions'] WHEN 'no-auto' THEN ['manual', 'download'] WHEN 'yt-dlp' THEN ['download'] ELSE ['apify'] END AS steps FROM r),
b AS (SELECT *, list_filter(steps, lambda s: text IS NOT NULL AND ((s IN ('download', 'apify') OR trim(text) <> '')) AND ((s = 'manual' AND doc_id % 2 = 0) OR (s = 'captions' AND doc_id % 7 = 0) OR (s = 'download' AND doc_id % 6 > 2) OR (s = 'apify' AND doc_id % 11 = 0)))[1] AS hit FROM a),
c AS (SELECT doc_id, text, mode, stop, CASE WHEN stop IS NULL THEN hit END AS provider, CASE WHEN stop IS NOT NULL THEN [] WHEN hit IS NULL THEN steps ELSE steps[1:list_position(steps, hit)] END AS tried FROM b)
SELECT doc_id, provider, array_to_string(tried, '|') AS attempted, CASE provider WHEN 'download' THEN md5('heard ' || text) WHEN 'apify' THEN md5('scraped ' || text) ELSE CASE WHEN provider IS NOT NULL THEN md5(text) END END AS digest,
concat_ws('|', stop, CASE WHEN list_contains(tried, 'manual') AND provider IS DISTINCT FROM 'manual' THEN 'no captions by hand, transcribing' END, CASE WHEN mode = 'auto' AND list_contains(tried, 'download') AND provider IS DISTINCT FROM 'download' THEN 'transcription failed, trying the scraper' END,
CASE WHEN stop IS NULL AND provider IS NULL THEN 'unavailable' END) AS notes FROM c""")
def video_transcripts(t):
    out = video_transcripts_of(t("documents"))
    return out.select("doc_id", "provider", F.array_join("attempted", "|").alias("attempted"), F.md5("value").alias("digest"), F.array_join("notes", "|").alias("notes"))


# sound, by key

def _hosted(name: str, k: Column, works: Column) -> Service:
    return answering(value=F.when(works, F.concat(F.lit(f"{name} "), k.cast("string"))), failure=F.when(~works, F.concat(F.lit(f"{name} is down at "), k.cast("string"))))


def audio_transcripts_of(parts: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    names = ("groq", "assemblyai", "gemini", "openai", "fal")
    keys = F.array_compact(F.array(*(F.when(k % (i + 2) > 0, name) for i, name in enumerate(names))))
    rows = parts.select("p_partkey", keys.alias("keys"), F.when(k % 4 == 0, "video/mp4").otherwise("Audio/mpeg").alias("media_type"))
    answers = {name: _hosted(name, k, k % (i + 7) == 0) for i, name in enumerate(names)} | {"whisper": answering(value=every(k, 31, "local"))}
    return resolve(rows, transcripts.audio_steps(answers, F.col("keys"), F.col("media_type")), transcripts.AUDIO_FACTS)


@query("""WITH k AS (SELECT p_partkey AS id, p_partkey % 4 > 0 AS audio FROM part),
s AS (SELECT id, ord, name, label, works, name IN ('assemblyai', 'gemini', 'openai', 'fal') AS hosted FROM k, LATERAL (VALUES (1, 'groq', 'Groq', id % 7 = 0, id % 2 > 0), (2, 'whisper', '', id % 31 = 0, true), (3, 'assemblyai', 'AssemblyAI', id % 8 = 0, id % 3 > 0), (4, 'gemini', 'Gemini', id % 9 = 0, id % 4 > 0), (5, 'openai', 'OpenAI', id % 10 = 0, id % 5 > 0), (6, 'fal', 'FAL', id % 11 = 0, id % 6 > 0 AND audio)) AS v(ord, name, label, works, able) WHERE able),
f AS (SELECT id, min(ord) FILTER (works) AS hit FROM s GROUP BY id),
u AS (SELECT s.*, hit, string_agg(CASE WHEN hosted THEN label END, '/') OVER (PARTITION BY s.id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM s JOIN f USING (id)),
n AS (SELECT *, CASE WHEN ord = hit OR name = 'whisper' THEN NULL WHEN name = 'groq' THEN 'Groq transcription failed; falling back to local/AssemblyAI/Gemini/OpenAI: groq is down at ' || id WHEN later IS NOT NULL THEN label || ' transcription failed; falling back to ' || later || ': ' || name || ' is down at ' || id END AS note FROM u WHERE hit IS NULL OR ord <= hit)
SELECT id AS p_partkey, max(name) FILTER (ord = hit) AS provider, string_agg(name, '|' ORDER BY ord) AS attempted, coalesce(string_agg(note, '|' ORDER BY ord), '') AS notes, max_by(name, ord) FILTER (ord IS DISTINCT FROM hit AND name <> 'whisper') AS failed FROM n GROUP BY id""")
def audio_transcripts(t):
    out = audio_transcripts_of(t("part"))
    return out.select("p_partkey", "provider", F.array_join("attempted", "|").alias("attempted"), F.array_join("notes", "|").alias("notes"), "failed")


# podcasts

def podcasts_of(docs: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    entity = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(F.struct(F.concat(F.lit("Show "), "source").alias("subtitle"), F.concat(F.lit("Épisode "), k).alias("title"), (k * 1000).alias("duration")).alias("entity"), F.struct(F.when(k % 4 == 0, "CBCS").otherwise("MP4").alias("format"), every(k, 2, F.concat(F.lit("https://cdn.example/"), k)).alias("url")).alias("defaultAudioFileObject")).alias("data")).alias("state")).alias("pageProps")).alias("props")))
    audio = F.get_json_object(F.regexp_extract("embed", "(?s)>(.*)</script>", 1), "$.props.pageProps.state.data.defaultAudioFileObject.url")
    item = F.concat(F.lit("<item><title><![CDATA[EPISODE "), k, F.lit("!]]></title>"), F.when(k % 5 == 0, F.concat(F.lit("<podcast:transcript url='https://t.example/"), k, F.lit("' type='text/vtt'/>"))).otherwise(""), F.when(k % 6 < 4, F.concat(F.lit("<enclosure url='https://e.example/"), k, F.lit("'/>"))).otherwise(""), F.lit("</item>"))
    said = F.when(F.startswith("media", F.lit("https://cdn")), F.left("text", (k % 9 * 100).cast("int"))).when(F.startswith("media", F.lit("https://e")), F.when(k % 3 > 0, F.col("text"))).otherwise(every(k, 4, F.col("text")))
    answers = {
        "embed": answering(embed=F.when(k % 17 > 0, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), entity, F.lit("</script>")))),
        "transcribe": answering(value=said, failure=every(k, 3, "busy")),
        "directory": answering(feed_url=F.when(k % 7 > 1, F.concat(F.lit("https://f.example/"), "show"))),
        "search": answering(media=every(k, 2, F.concat(F.lit("https://s.example/"), k))),
        "feed": answering(feed_status=F.when(k % 13 > 0, F.lit(200)).when(k % 2 == 0, F.lit(404)), feed=F.concat(F.lit("<rss><channel><item><title>Other</title></item>"), F.when(k % 8 > 0, item).otherwise(""), F.lit("</channel></rss>"))),
        "feed_transcript": answering(value=F.when(k % 10 == 0, F.concat("media", F.lit(" "), "text"))),
    }
    return resolve(docs.select("doc_id", "text", "source"), transcripts.podcast_steps(answers, audio), transcripts.PODCAST_FACTS)


@query("""WITH d AS (SELECT doc_id AS k, text, coalesce(trim(text), '') <> '' AS has, doc_id % 17 = 0 AS lost, doc_id % 4 = 0 AS sealed, doc_id % 2 = 0 AND doc_id % 4 > 0 AS sound, substr(text, 1, doc_id % 9 * 100) AS clip FROM documents),
e AS (SELECT *, length(trim(clip, ' ')) AS n FROM d),
f AS (SELECT *, sound AND n > 0 AND (n < 200 OR (n < 800 AND k >= 600)) AS short, sound AND coalesce(n, 0) = 0 AS mute, k % 7 < 2 AS feedless FROM e),
g AS (SELECT *, CASE WHEN lost THEN 'lost' WHEN sound AND NOT short AND NOT mute THEN 'embedded_sound' WHEN feedless THEN CASE WHEN k % 2 > 0 THEN 'no_feed' WHEN k % 4 = 0 AND has THEN 'searched_episode' ELSE 'searched_no_feed' END WHEN k % 13 = 0 THEN 'feed_failed' WHEN k % 8 > 0 AND k % 10 = 0 AND has THEN 'feed_transcript'
WHEN k % 8 > 0 AND k % 6 < 4 THEN CASE WHEN k % 3 > 0 AND has THEN 'enclosure' ELSE 'enclosure_failed' END WHEN k % 2 > 0 THEN 'no_episode' WHEN k % 4 = 0 AND has THEN 'searched_later' ELSE 'searched_no_episode' END AS how FROM f)
SELECT k AS doc_id, CASE WHEN how IN ('embedded_sound', 'searched_episode', 'feed_transcript', 'enclosure', 'searched_later') THEN how END AS provider, CASE how WHEN 'searched_later' THEN 'searched_episode' WHEN 'embedded_sound' THEN how WHEN 'searched_episode' THEN how WHEN 'feed_transcript' THEN how WHEN 'enclosure' THEN how END AS kind,
md5(CASE how WHEN 'embedded_sound' THEN clip WHEN 'feed_transcript' THEN 'https://t.example/' || k || ' ' || text WHEN 'searched_episode' THEN text WHEN 'enclosure' THEN text WHEN 'searched_later' THEN text END) AS digest,
concat_ws('|', CASE WHEN lost THEN 'embedded data not found' WHEN sealed AND k % 2 = 0 THEN 'embedded sound is encrypted (CBCS), trying the feed' END, CASE WHEN NOT lost AND short THEN 'embedded sound is a clip of ' || n || ' characters, trying the feed' WHEN NOT lost AND mute THEN 'transcription failed: ' || CASE WHEN k % 3 = 0 THEN 'busy' ELSE 'unknown error' END END,
CASE how WHEN 'no_feed' THEN 'no feed found for the show' WHEN 'searched_no_feed' THEN 'no feed found for the show' WHEN 'feed_failed' THEN 'feed fetch failed (' || CASE WHEN k % 2 = 0 THEN '404' ELSE 'no answer' END || ')' WHEN 'enclosure_failed' THEN 'transcription of the enclosure failed' WHEN 'no_episode' THEN 'episode not found in the feed' WHEN 'searched_no_episode' THEN 'episode not found in the feed' END) AS notes FROM g""")
def podcast_chain(t):
    out = podcasts_of(t("documents"))
    return out.select("doc_id", "provider", "kind", F.md5("value").alias("digest"), F.array_join("notes", "|").alias("notes"))


# sound in parts

def _part(broken: Column) -> Service:
    said = F.when(F.col("part") % 7 == 6, " ").otherwise(F.concat(F.col("part").cast("string"), F.lit(":"), F.col("text")))
    return answering(value=F.when(~broken, said), failure=F.when(broken, F.concat(F.lit("part "), F.col("part").cast("string"), F.lit(" lost"))))


@query("""WITH p AS (SELECT doc_id, text, unnest(range((length(text) + 1999) // 2000)) AS part FROM documents WHERE length(text) > 0),
q AS (SELECT doc_id, part, (doc_id + part) % 46 = 0 AS lost, part || ':' || substr(text, part * 2000 + 1, 2000) AS said FROM p),
r AS (SELECT doc_id, count(*)::INT AS parts, min(part) FILTER (lost) AS cut, coalesce(string_agg(said, chr(10) || chr(10) ORDER BY part) FILTER (NOT lost AND part % 7 < 6), '') AS said FROM q GROUP BY doc_id)
SELECT doc_id, coalesce(parts, 0) AS parts, coalesce(cut, parts, 0)::INT AS done, md5(CASE WHEN cut IS NULL THEN said END) AS digest, CASE WHEN parts IS NULL THEN 'no parts' WHEN cut IS NOT NULL THEN 'part ' || cut || ' lost' END AS error, 'cut into ' || parts || ' parts of 2000' AS notes FROM documents LEFT JOIN r USING (doc_id)""")
def chunked_transcripts(t):
    k = F.col("doc_id") + F.col("part")
    out = transcripts.chunked(t("documents").select("doc_id", "text"), "doc_id", "text", 2000, [_part(k % 23 == 0), _part(k % 46 == 0)])
    return out.select("doc_id", "parts", "done", F.md5("text").alias("digest"), "error", "notes")


# tokens

#: A public vocabulary's ranks; a parameter of the functions.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query()
def token_counts(t):
    docs = t("documents")
    columns = tokens.TokenColumns(docs.sparkSession, tokens.read_ranks(docs.sparkSession, RANKS))
    rows = docs.select("doc_id", columns.counted(F.col("text"), F.lit(200)).alias("t"))
    return rows.select("doc_id", F.col("t.n").alias("n_tokens"), F.md5("t.cut").alias("cut_digest"), F.length("t.cut").alias("cut_chars"))
