"""Registered queries of sessions, progress and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import clock, services as V
from loomtext.operators import media as D, readable as RD, routing as R, streams as S
from loomtext.plans import extract as X
from loomtext.plans.registry import query


@query("""WITH e AS (SELECT user_id, event_id AS seq, epoch_us(ts) // 1000 AS pos, length(props) * 10 AS size, event_type = 'purchase' AND event_id % 3 = 0 AS last FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos, seq) AS n FROM e),
z AS (SELECT user_id, min(n) AS last_n, min_by(pos, n) AS end_pos FROM o WHERE last GROUP BY user_id),
k AS (SELECT o.*, coalesce(z.end_pos, max(pos) OVER (PARTITION BY o.user_id)) AS end_pos FROM o LEFT JOIN z USING (user_id) WHERE last_n IS NULL OR n <= last_n),
s AS (SELECT user_id, 1 AS subscriber, min(pos) + 1000 AS joined FROM o GROUP BY user_id UNION ALL SELECT user_id, 2, min(pos) + 400000000 FROM o GROUP BY user_id),
r AS (SELECT subscriber, user_id, n, pos <= joined AS old, sum(size) OVER (PARTITION BY subscriber, user_id, pos <= joined ORDER BY n DESC) AS held FROM k JOIN s USING (user_id)),
b AS (SELECT subscriber, user_id, greatest(0, (max(end_pos) - joined - 1) // 36000000) AS beats FROM k JOIN s USING (user_id) GROUP BY subscriber, user_id, joined)
SELECT subscriber, user_id, count(*) FILTER (old AND held <= 900) AS replayed, min(n) FILTER (old AND held <= 900) AS first_replayed, count(*) FILTER (NOT old) AS lived, max(n) FILTER (NOT old) AS last_lived, max(beats)::BIGINT AS beats FROM r JOIN b USING (subscriber, user_id) GROUP BY subscriber, user_id""")
def session_replay(t):
    from pyspark.sql import Window

    rows = t("events").select("user_id", F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (F.length("props") * 10).alias("size"), ((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0)).alias("last"))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("at", "event_id")).cast("long")).drop("event_id")
    first = rows.groupBy("user_id").agg(F.min("at").alias("first"))
    subscribers = first.select("user_id", F.lit(1).alias("subscriber"), (F.col("first") + 1000).alias("joined")).union(first.select("user_id", F.lit(2), F.col("first") + 400_000_000))
    out = S.subscriptions(rows, subscribers, "user_id", 900, 36_000_000)
    pick = lambda kind: F.when(F.col("kind") == kind, F.col("seq"))
    return out.groupBy("subscriber", "user_id").agg(F.count(pick("replay")).alias("replayed"), F.min(pick("replay")).alias("first_replayed"), F.count(pick("live")).alias("lived"), F.max(pick("live")).alias("last_lived"), F.count_if(F.col("kind") == "keepalive").alias("beats"))


@query("""WITH p AS (SELECT doc_id, text, unnest(range((length(text) + 99) // 100)) AS part FROM documents WHERE length(text) > 0),
q AS (SELECT *, substr(text, 1, (part + 1) * 100) AS seen FROM p),
r AS (SELECT *, strlen(seen) AS size, strlen(seen) >= 700 AND ((contains(seen, 'the') AND contains(seen, 'tion')) OR contains(seen, 'ung ')) AS ended FROM q),
f AS (SELECT *, min(part) FILTER (ended) OVER (PARTITION BY doc_id) AS stop FROM r)
SELECT doc_id, count(*) AS parts, max(size)::BIGINT AS size, bool_or(ended) AS ended FROM f WHERE stop IS NULL OR part <= stop GROUP BY doc_id""")
def early_end(t):
    docs = t("documents").where(F.length("text") > 0)
    part = F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 100).cast("int") - 1))
    chunks = docs.withColumn("part", part).select("doc_id", "part", F.substring("text", F.col("part") * 100 + 1, F.lit(100)).alias("chunk"))
    read = S.early_ended(chunks, "doc_id", "part", "chunk", 700, (("the", "tion"), ("ung ",)))
    return read.groupBy("doc_id").agg(F.count("*").alias("parts"), F.max("size").alias("size"), F.bool_or("ended").alias("ended"))


KINDS = ("fetch-html-start", "firecrawl-start", "firecrawl-done", "transcript-start", "transcript-media-download-start", "transcript-media-download-progress", "transcript-whisper-start", "transcript-whisper-progress", "transcript-done", "bird-start", "bird-done", "nitter-start", "nitter-done", "other")


@query(f"""WITH e AS (SELECT event_id, ({list(KINDS)})[event_id % 14 + 1] AS kind, event_type AS service, CASE WHEN event_id % 3 = 0 THEN ' ' WHEN event_id % 3 = 1 THEN ' ' || event_type || ' ' END AS hint, event_id % 5 > 1 AS ok, value AS done, CASE WHEN event_id % 4 > 0 THEN value * (event_id % 6) END AS total,
CASE WHEN event_id % 7 > 2 THEN value * 2 END AS total_seconds, (event_id // 14 % 9)::INT AS part, CASE WHEN event_id % 11 > 3 THEN 8 WHEN event_id % 11 > 1 THEN 0 END AS parts FROM events),
f AS (SELECT *, CASE WHEN total > 0 THEN ' ' || least(100, greatest(0, round(done / total * 100)))::INT || '%' ELSE '' END AS share, CASE WHEN total_seconds > 0 THEN ' ' || least(100, greatest(0, round(done / total_seconds * 100)))::INT || '%' WHEN parts > 0 THEN ' ' || least(100, round(part / parts * 100))::INT || '%' ELSE '' END AS heard FROM e)
SELECT event_id, CASE kind WHEN 'fetch-html-start' THEN 'Fetching…' WHEN 'firecrawl-start' THEN 'Firecrawl… (' || service || ')' WHEN 'firecrawl-done' THEN CASE WHEN ok THEN 'Firecrawl: done' ELSE 'Firecrawl: failed' END WHEN 'transcript-start' THEN CASE WHEN trim(hint) <> '' THEN trim(hint) ELSE 'Transcript…' END
WHEN 'transcript-media-download-start' THEN service || ': downloading audio…' WHEN 'transcript-media-download-progress' THEN service || ': downloading audio…' || share WHEN 'transcript-whisper-start' THEN service || ': transcribing…' WHEN 'transcript-whisper-progress' THEN service || ': transcribing…' || heard
WHEN 'transcript-done' THEN service || CASE WHEN ok THEN ': transcript ready' ELSE ': transcript unavailable' END WHEN 'bird-start' THEN 'X: extracting tweet' || CASE WHEN event_id % 3 = 1 THEN ' ( ' || service || ' )' WHEN event_id % 3 = 0 THEN ' ( )' ELSE '' END || '…' WHEN 'nitter-start' THEN 'X: extracting tweet (nitter)…' WHEN 'other' THEN NULL ELSE CASE WHEN ok THEN 'X: extracted tweet' ELSE 'X: extract failed' END END AS said FROM f""")
def progress_texts(t):
    k, v = F.col("event_id"), F.col("value")
    hint = F.when(k % 3 == 0, " ").when(k % 3 == 1, F.concat(F.lit(" "), "event_type", F.lit(" ")))
    e = F.struct(
        F.element_at(F.array(*map(F.lit, KINDS)), (k % 14 + 1).cast("int")).alias("kind"), F.col("event_type").alias("service"), F.col("event_type").alias("reason"), hint.alias("hint"), hint.alias("client"), (k % 5 > 1).alias("ok"), v.alias("done"), F.when(k % 4 > 0, v * (k % 6)).alias("total"),
        v.alias("seconds"), F.when(k % 7 > 2, v * 2).alias("total_seconds"), F.floor(k / 14 % 9).cast("int").alias("part"), F.when(k % 11 > 3, 8).when(k % 11 > 1, 0).alias("parts"),
    )
    return t("events").select("event_id", V.progress_text(e).alias("said"))


@query("SELECT conv_id, greatest(last_said, CASE WHEN conv_id % 4 = 0 THEN NULL WHEN conv_id % 4 = 1 THEN floor(conv_id * 0.7) ELSE NULL END)::DOUBLE AS upper FROM (SELECT conv_id, CASE WHEN conv_id % 3 > 0 THEN max(turn) * 7 END AS last_said FROM conversations GROUP BY conv_id)")
def time_bounds(t):
    k = F.col("conv_id")
    rows = t("conversations").groupBy("conv_id").agg(F.max("turn").alias("m"))
    duration = F.when(k % 4 == 1, k * 0.7).when(k % 4 == 2, -1.0).when(k % 4 == 3, float("nan"))
    return rows.select("conv_id", clock.upper_bound(F.when(k % 3 > 0, F.col("m") * 7), duration).alias("upper"))


@query("""WITH c AS (SELECT p_brand AS id, max_by({'c': p_size, 'o': p_partkey % 9, 'p': p_partkey % 5, 'm': p_type}, p_partkey) AS m FROM part WHERE p_brand NOT LIKE '%3' GROUP BY p_brand), w AS (SELECT p_brand AS id, count(*) AS successes FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand)
SELECT id, successes, m.c AS context_length, m.o AS max_output, coalesce(m.p, 0) AS parameters, m.m AS modality FROM w LEFT JOIN c USING (id)""")
def model_metadata(t):
    parts, k = t("part"), F.col("p_partkey")
    catalog = parts.where(~F.col("p_brand").like("%3")).select(F.col("p_brand").alias("id"), F.col("p_size").alias("context_length"), (k % 9).alias("max_output"), (k % 5).alias("parameters"), F.col("p_type").alias("modality"), k.alias("pos"))
    return R.with_metadata(parts.where(k % 2 == 0).groupBy(F.col("p_brand").alias("id")).agg(F.count("*").alias("successes")), catalog)


@query("""WITH r AS (SELECT l_orderkey AS id, l_linenumber * 1000000 + l_partkey AS pos, CASE WHEN l_partkey % 7 > 0 THEN 'The Show: ' || (l_partkey % 4) END AS title, CASE WHEN l_partkey % 5 = 0 THEN 'ftp://f/' WHEN l_partkey % 5 = 1 THEN NULL ELSE ' https://f.example/' END || l_partkey || CASE WHEN l_partkey % 5 > 1 THEN ' ' ELSE '' END AS feed FROM lineitem),
b AS (SELECT id, (list({'f': trim(feed)} ORDER BY CASE WHEN title = 'The Show: ' || (o_orderkey % 4) THEN 0 ELSE 1 END, pos))[1].f AS feed_url FROM r JOIN orders ON o_orderkey = id GROUP BY id) SELECT id, feed_url FROM b WHERE feed_url LIKE 'http%'""")
def show_feeds(t):
    k = F.col("l_partkey")
    results = t("lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 1_000_000 + k).alias("pos"), F.when(k % 7 > 0, F.concat(F.lit("The Show: "), (k % 4).cast("string"))).alias("collection"), F.when(k % 5 == 0, F.concat(F.lit("ftp://f/"), k)).when(k % 5 > 1, F.concat(F.lit(" https://f.example/"), k, F.lit(" "))).alias("feed_url"))
    wanted = t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("the SHOW "), (F.col("o_orderkey") % 4).cast("string")).alias("show"))
    return D.show_feeds(wanted, results)


@query(r"""WITH p AS (SELECT page_id, page_id % 8 AS m, url, html, CASE WHEN page_id % 3 = 0 THEN ' said ' || page_id || chr(9) || 'it ' WHEN page_id % 9 = 1 THEN ' ' END AS said FROM pages),
q AS (SELECT *, CASE m WHEN 0 THEN 'video' WHEN 1 THEN 'podcast_episode' WHEN 2 THEN 'podcast_show' WHEN 3 THEN 'message' WHEN 4 THEN 'broadcast' WHEN 5 THEN 'media' ELSE 'html' END AS strategy, page_id % 3 = 0 AS spoken FROM p)
SELECT page_id, strategy, CASE WHEN strategy = 'html' THEN regexp_matches(lower(html), '<video|<audio|<track|og:video|og:audio|youtube\.com/embed|youtu\.be/') ELSE true END AS probe, CASE WHEN spoken THEN 'Transcript:' || chr(10) || 'said ' || page_id || ' it' WHEN strategy <> 'html' THEN '' END AS content,
CASE WHEN m = 0 THEN 'https://www.youtube.com/watch?v=' || substr(md5(page_id::VARCHAR), 1, 11) END AS video_url, m = 0 AS is_video_only, CASE WHEN spoken OR strategy <> 'html' THEN m NOT IN (0, 1, 2, 5) END AS short FROM q""")
def routed_pages(t):
    k = F.col("page_id")
    links = ["https://youtu.be/@", "https://open.spotify.com/episode/@", "https://podcasts.apple.com/us/podcast/x/id1?i=2", "https://x.com/a/status/12", "https://x.com/i/broadcasts/@", "https://a.example/@.mp3"]
    link = F.replace(F.get(F.array(*map(F.lit, links), F.col("url"), F.col("url")), (k % 8).cast("int")), F.lit("@"), F.substring(F.md5(k.cast("string")), 1, 11))
    said = F.when(k % 3 == 0, F.concat(F.lit(" said "), k.cast("string"), F.lit("\tit "))).when(k % 9 == 1, " ")
    out = X.extract(t("pages").select("page_id", link.alias("url"), "html", said.alias("said")), transcript_col="said")
    sure = (k % 3 == 0) | (F.col("strategy") != "html")
    return out.select("page_id", "strategy", "probe", F.when(sure, F.col("content")).alias("content"), F.when(F.col("strategy") != "html", F.col("video_url")).alias("video_url"), F.when(F.col("strategy") != "html", F.col("is_video_only")).otherwise(False).alias("is_video_only"), F.when(sure, F.col("short")).alias("short"))


@query()
def readable_pages(t):
    return RD.readable_texts(t("pages"), "page_id", "html").select("page_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"), F.round("score", 6).alias("score"))
