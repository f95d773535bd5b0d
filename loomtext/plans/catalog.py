"""Registered queries over the driver's tables and, where a query is SQL, the
same for DuckDB. Queries without SQL here are checked by unit tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomtext.functions import clock, dom, payloads, services as V, text as T, urls
from loomtext.operators import cache as C, media as D, metrics as M, routing as R, streams as S, thinning as N, timeline as L
from loomtext.plans import catalog_services as _services, catalog_states as _states, catalog_streams as _streams, extract as X  # noqa: F401 - they register queries
from loomtext.plans.goldens import GOLDENS
from loomtext.plans.registry import ORACLES, QUERIES, query

NOW = 1_706_000_000_000
WS = T.SPACE


def _ms():
    return F.unix_millis(F.col("ts").cast("timestamp"))


# SQL of text functions, as strings

def s_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+\\z', '', 'g')"


def s_norm(x: str) -> str:
    return s_trim(f"regexp_replace(regexp_replace(replace(regexp_replace({x}, '{T.INVISIBLE}', '', 'g'), chr(160), ' '), '[\\t ]+', ' ', 'g'), '[{WS}]*\\n[{WS}]*', chr(10), 'g')")


def s_words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> ''))"


def s_last(x: str, part: str) -> str:
    back = part[::-1].replace("\n", "' || chr(10) || '")
    return f"(CASE WHEN strpos(reverse({x}), '{back}') > 0 THEN length({x}) - strpos(reverse({x}), '{back}') - {len(part)} + 1 ELSE -1 END)"


def s_clip(x: str, most: int) -> str:
    head = f"substr({x}, 1, {most})"
    end = f"greatest({', '.join(s_last(head, p) for p in ('. ', '! ', '? ', chr(10) * 2))})"
    return f"CASE WHEN length({x}) <= {most} THEN {x} WHEN {end} > {most * 0.5} THEN substr({head}, 1, {end} + 1) ELSE {head} END"


S_MS = "(CASE WHEN {0} >= 3600 THEN ({0} // 3600)::VARCHAR || ':' || lpad(({0} % 3600 // 60)::VARCHAR, 2, '0') ELSE ({0} // 60)::VARCHAR END || ':' || lpad(({0} % 60)::VARCHAR, 2, '0'))"


# text

@query(f"SELECT doc_id, sha256({s_norm('text')}) AS digest, length({s_norm('text')})::INTEGER AS n FROM documents")
def norm_prompt(t):
    x = T.normalize_for_prompt(F.col("text"))
    return t("documents").select("doc_id", F.sha2(x, 256).alias("digest"), F.length(x).alias("n"))


@query(f"SELECT doc_id, nullif(length(text), 0)::INTEGER AS characters, nullif(len(list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: {s_trim('x')} <> '')), 0)::INTEGER AS lines, nullif({s_words('text')}, 0)::INTEGER AS words FROM documents")
def word_counts(t):
    return t("documents").select("doc_id", T.transcript_counts(F.col("text")).alias("c")).select("doc_id", "c.*")


@query(f"SELECT doc_id, {s_clip('text', 300)} AS clip FROM documents")
def sentence_clip(t):
    return t("documents").select("doc_id", T.clip_at_sentence(F.col("text"), 300).alias("clip"))


def _s_budget(most: int) -> str:
    room = most - len(T.OMISSION)
    first = room * 3 // 4
    rest = room - first
    mark = T.OMISSION.replace("\n", "' || chr(10) || '")
    return f"""WITH a AS (SELECT doc_id, text, substr(text, 1, {first}) AS head, right(text, {rest}) AS tail FROM documents),
b AS (SELECT *, greatest({', '.join(s_last('head', p) for p in ('. ', '! ', '? ', chr(10)))}) AS cut,
  least({', '.join(f"CASE WHEN strpos(tail, {p}) > 0 THEN strpos(tail, {p}) - 1 END" for p in ("chr(10)", "'. '", "'! '", "'? '"))}, {rest}) AS start FROM a),
c AS (SELECT *, CASE WHEN cut > {first * 0.5} THEN substr(head, 1, cut + 1) ELSE head END AS h, CASE WHEN start < {rest * 0.5} THEN substr(tail, start + 2) ELSE tail END AS u FROM b),
d AS (SELECT doc_id, text, {s_trim(f"CASE WHEN length(text) <= {most} THEN text ELSE regexp_replace(h, '[{WS}]+" + chr(92) + f"z', '') || '{mark}' || regexp_replace(u, '^[{WS}]+', '') END")} AS content FROM c)
SELECT doc_id, sha256(content) AS digest, length(text) > {most} AS truncated, length(text)::INTEGER AS total_characters, {s_words('content')}::INTEGER AS word_count FROM d"""


@query(_s_budget(1500))
def head_tail_budget(t):
    rows = t("documents").select("doc_id", T.content_budget(F.col("text"), 1500).alias("b"))
    return rows.select("doc_id", F.sha2("b.content", 256).alias("digest"), "b.truncated", "b.total_characters", "b.word_count")


@query(f"SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE CASE WHEN c <> '' THEN c || '...' WHEN {s_trim('h')} = '' THEN '' ELSE {s_trim('h')} || '...' END END AS cut FROM (SELECT *, {s_trim(f'''regexp_replace(h, '[{WS}]+[^{WS}]*' || chr(92) || 'z', '')''')} AS c FROM (SELECT *, regexp_replace(substr(text, 1, 120), '[{WS}]+\\z', '') AS h FROM documents))".replace("' || chr(92) || 'z'", "\\z'"))
def truncated_texts(t):
    return t("documents").select("doc_id", T.truncate_words(F.col("text"), 120).alias("cut"))


@query("SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens, greatest(256, ceil(length(text) / 4))::BIGINT AS completion, CASE WHEN length(text) <= 1200 THEN 'short' WHEN length(text) <= 2500 THEN 'medium' WHEN length(text) <= 6000 THEN 'long' WHEN length(text) <= 14000 THEN 'xl' ELSE 'xxl' END AS preset FROM documents")
def length_presets(t):
    from loomtext.functions import options as O

    n = F.length("text")
    return t("documents").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"), clock.completion_tokens(n).alias("completion"), O.preset_for(n).alias("preset"))


@query(f"SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY sha256({s_norm('text')}) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first(t):
    rows = t("documents").select(F.sha2(T.normalize_for_prompt(F.col("text")), 256).alias("k"), "doc_id", "text")
    return M.first_rows(rows, ["k"], ["doc_id"]).select("doc_id", "text")


@query("SELECT lang, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS labelled, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS bare FROM documents GROUP BY lang")
def anti_semi(t):
    docs, labels = t("documents").select("doc_id", "lang"), t("labels").select("doc_id")
    with_, without = docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti")
    both = with_.select("lang", F.lit(1).alias("a"), F.lit(0).alias("b")).union(without.select("lang", F.lit(0), F.lit(1)))
    return both.groupBy("lang").agg(F.sum("a").alias("labelled"), F.sum("b").alias("bare"))


@query(r"SELECT doc_id, concat_ws('-', nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64), '-+$', ''), ''), nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(substr(text, 1, 90)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64), '-+$', ''), ''), substr(sha1(text), 1, 8)) AS id FROM documents")
def source_ids(t):
    return t("documents").select("doc_id", T.source_id(F.col("source"), F.substring("text", 1, 90), F.col("text")).alias("id"))


@query("SELECT doc_id, sha256('<instructions>' || chr(10) || 'Write the result in ' || lang || '.' || chr(10) || '</instructions>' || chr(10) || chr(10) || '<context>' || chr(10) || source || chr(10) || '</context>' || chr(10) || chr(10) || '<content>' || chr(10) || text || chr(10) || '</content>' || chr(10)) AS digest FROM documents")
def summary_prompt(t):
    from loomtext.functions import options as O

    prompt = O.tagged_prompt(F.concat(F.lit("Write the result in "), F.col("lang"), F.lit(".")), F.col("source"), F.col("text"))
    return t("documents").select("doc_id", F.sha2(prompt, 256).alias("digest"))


@query(f"SELECT doc_id, CASE WHEN starts_with(lower(x), lower(y)) AND y <> '' THEN regexp_replace(substr(x, length(y) + 1), '^[{WS}[:cntrl:]]+', '') ELSE text END AS body FROM (SELECT *, regexp_replace(text, '^[{WS}]+', '') AS x, {s_trim('substr(text, 1, 7)')} AS y FROM documents)")
def leading_title(t):
    return t("documents").select("doc_id", T.strip_leading_title(F.col("text"), F.lower(F.substring("text", 1, 7))).alias("body"))


# pages and URLs

@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&#x2F;', '/'), '&nbsp;', ' ')) AS digest FROM pages")
def entity_decode(t):
    return t("pages").select("page_id", F.sha2(T.decode_html_entities(F.col("html")), 256).alias("digest"))


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source, CASE WHEN regexp_extract(url, '^[a-z]+://[^?#]*', 0) SIMILAR TO '.*/[^/]*[^/]\.html' THEN 'html' END AS extension, 'website' AS kind FROM pages")
def url_parts(t):
    u, none = F.col("url"), F.lit(None).cast("string")
    return t("pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.parameter(u, "utm_source").alias("utm_source"), urls.path_extension(u).alias("extension"), urls.url_kind(u, none, none, none).alias("kind"))


@query("SELECT page_id, false AS video, false AS media, false AS podcast, false AS message, 'html' AS strategy, 'generic' AS provider FROM pages")
def url_class(t):
    u = F.col("url")
    return t("pages").select("page_id", urls.is_video_page(u).alias("video"), urls.is_direct_media(u).alias("media"), urls.is_podcast_host(u).alias("podcast"), (urls.is_message_status(u) | urls.is_message_broadcast(u)).alias("message"), X.strategy(u).alias("strategy"), X.transcript_provider(u, F.col("html")).alias("provider"))


@query(f"SELECT page_id, {s_trim(f'''regexp_replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&'), '[{WS}]+', ' ', 'g')''')} AS title, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '') AS site FROM pages")
def page_title_host(t):
    return t("pages").select("page_id", dom.facts(F.col("html"), F.col("url")).alias("f")).select("page_id", F.col("f.title").alias("title"), F.col("f.site_name").alias("site"))


@query(r"SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '<!--(.|\n)*?-->', '', 'g'), '<script(.|\n)*?</script>', '', 'g'), '<style(.|\n)*?</style>', '', 'g'))::INTEGER AS n FROM pages")
def html_precut(t):
    return t("pages").select("page_id", F.length(dom.told_markup_col(F.col("html"))).alias("n"))


@query()
def article_segments(t):
    return t("pages").select("page_id", dom.facts(F.col("html"), F.col("url")).alias("f")).select("page_id", F.size("f.segments").alias("n"), F.sha2(F.array_join("f.segments", "\n"), 256).alias("digest"), F.length("f.article").alias("article_chars"))


@query()
def extracted_pages(t):
    return X.extract(t("pages"))


@query()
def host_report(t):
    return X.host_report(t("pages"))


# conversations

@query(f"SELECT conv_id, string_agg('[' || {S_MS.format('(turn * 7)')} || '] ' || {s_trim(f'''regexp_replace(text, '[ {chr(92)}t{chr(92)}n{chr(92)}x0B{chr(92)}f{chr(92)}r]+', ' ', 'g')''')}, chr(10) ORDER BY turn) AS timed FROM conversations GROUP BY conv_id")
def timed_text(t):
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("turn") * 7000).alias("startMs"), F.col("text").alias("text")))).alias("s"))
    return rows.select("conv_id", clock.timed_text(F.col("s")).alias("timed"))


@query()
def stream_merge(t):
    return S.merged_chunks(t("conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text").select("conv_id", "turn", F.length("appended").alias("appended"), "total")


def slide_chunks(talks: DataFrame, size: int) -> DataFrame:
    """Conversations as streams of ``size`` characters: each turn under one of four
    kinds of slide marker, with a title line; two slides more are expected than marked."""
    n = (F.col("turn") + 1).cast("string")
    marks = [F.concat(F.lit("[slide:"), n, F.lit("]\n")), F.concat(F.lit("Slide "), n, F.lit(" of 9 - \u00b7 more\n")), F.concat(F.lit("slide: "), n, F.lit("]\n")), F.concat(F.lit("[as on slide "), n, F.lit("] "))]
    mark = F.element_at(F.array(*marks), (F.col("turn") % 4 + 1).cast("int"))
    title = F.element_at(F.array(F.concat("role", F.lit("  "), n), F.concat(F.lit("## "), "role"), F.concat(F.lit("Title: "), "role", F.lit(".")), F.concat(F.lit("headline:\n\n"), "role", n)), (F.col("conv_id") % 4 + 1).cast("int"))
    full = F.concat(F.when(F.col("turn") == 0, "[slides]Before it\n").otherwise(""), mark, title, F.lit("\n"), "text", F.lit("\n"))
    rows = talks.select("conv_id", "turn", full.alias("full"), (F.max("turn").over(Window.partitionBy("conv_id")) + 3).cast("int").alias("expected"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("full") / size) - 1, F.lit(0)).cast("int")))
    return rows.withColumn("i", at).select("conv_id", "turn", "i", F.col("full").substr(F.col("i") * size + 1, F.lit(size)).alias("chunk"), "expected")


@query("""WITH c AS (SELECT *, CASE conv_id % 4 WHEN 0 THEN role || ' ' || (turn + 1) WHEN 1 THEN role WHEN 2 THEN role || '.' ELSE role || (turn + 1) END AS title FROM conversations)
SELECT conv_id, 0 AS part, NULL::INT AS slide, NULL AS title, 'Before it' || chr(10) AS text FROM c WHERE turn = 0
UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT, (turn + 1)::INT, title, text || chr(10) FROM c
UNION ALL SELECT conv_id, (n + k)::INT, (most + 1 + k)::INT, NULL, '' FROM (SELECT conv_id, count(*) AS n, max(turn) AS most FROM c GROUP BY 1), (VALUES (1), (2)) AS v(k)""")
def slide_stream(t):
    events = S.slide_events(slide_chunks(t("conversations"), 7), "conv_id", ["turn", "i"], "chunk", "expected")
    return S.slide_parts(events, "conv_id").withColumn("part", F.col("part").cast("int"))


@query("""WITH c AS (SELECT user_id::VARCHAR AS stream_id, epoch_us(ts) // 1000 AS pos, event_type = 'purchase' AS done FROM events),
s AS (SELECT *, min(pos) OVER (PARTITION BY stream_id) AS started FROM c),
e AS (SELECT *, min(pos) FILTER (done AND pos <= started + 129600000) OVER (PARTITION BY stream_id) AS done_at, row_number() OVER (PARTITION BY stream_id ORDER BY pos, done) AS n FROM s),
f AS (SELECT *, coalesce(done_at, started + 129600000) AS ended, min(n) FILTER (done AND pos = done_at) OVER (PARTITION BY stream_id) AS end_n FROM e)
SELECT stream_id, CASE WHEN max(done_at) IS NULL THEN 'timed out' ELSE 'done' END AS status, max(ended) AS ended, max(ended) + 90000000 AS expires, max(started) AS started,
count(*) FILTER (CASE WHEN end_n IS NULL THEN pos <= ended ELSE n <= end_n END) AS chunks, count(*) FILTER (CASE WHEN end_n IS NULL THEN pos > ended ELSE n > end_n END AND pos <= ended + 90000000) AS late, count(*) FILTER (pos > ended + 90000000) AS gone
FROM f GROUP BY stream_id""")
def stream_ends(t):
    chunks = t("events").select(F.col("user_id").cast("string").alias("stream_id"), _ms().alias("at"), (F.col("event_type") == "purchase").alias("done"))
    return S.stream_ends(chunks, 129_600_000, 90_000_000)


@query("SELECT conv_id, max_by(role, turn) AS role, max(turn) FILTER (role = 'user') AS user_turn FROM conversations GROUP BY conv_id")
def session_meta(t):
    rows = t("conversations").withColumn("user_turn", F.when(F.col("role") == "user", F.col("turn")))
    return S.session_meta(rows, "conv_id", "turn", ("role", "user_turn"))


@query("SELECT conv_id, turn, role FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS held FROM conversations) WHERE held <= 500")
def ring_buffer(t):
    return S.buffered(t("conversations").withColumn("size", F.length("text")), "conv_id", "turn", "size", 500).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, 'event: ' || role || chr(10) || 'data: ' || turn || chr(10) || chr(10) AS message FROM conversations")
def sse_messages(t):
    return S.sse(t("conversations").withColumn("data", F.col("turn").cast("string")), "role", "data").select("conv_id", "turn", "message")


# metrics over lineitem, part and events

@query("SELECT l_returnflag AS provider, l_linestatus AS model, count(*) AS calls, sum(l_quantity) AS prompt_tokens, sum(CASE WHEN l_tax > 0 THEN l_quantity END) AS completion_tokens, sum(l_linenumber)::BIGINT AS total_tokens FROM lineitem GROUP BY ALL")
def usage_report(t):
    calls = t("lineitem").select(F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("model"), F.col("l_quantity").alias("prompt_tokens"), F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("completion_tokens"), F.col("l_linenumber").cast("long").alias("total_tokens"))
    return M.usage_by_model(calls)


@query("SELECT l_returnflag AS provider, round(sum(CASE WHEN l_discount > 0.08 THEN l_tax ELSE l_quantity * p_retailprice + l_linenumber * p_size END), 2) AS cost FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def cost_estimate(t):
    calls = t("lineitem").select(F.col("l_returnflag").alias("provider"), F.col("l_partkey").alias("model"), F.col("l_quantity").alias("prompt_tokens"), F.col("l_linenumber").alias("completion_tokens"), F.when(F.col("l_discount") > 0.08, F.col("l_tax")).alias("cost_usd"))
    prices = t("part").select(F.col("p_partkey").alias("model"), F.col("p_retailprice").alias("input_usd_per_token"), F.col("p_size").alias("output_usd_per_token"))
    return M.total_cost(calls, prices, ["provider"]).withColumn("cost", F.round("cost", 2))


@query("WITH r AS (SELECT p_partkey::VARCHAR AS id, p_size AS c, p_retailprice AS m, row_number() OVER (ORDER BY p_size DESC, p_partkey % 7 DESC, p_partkey % 5 DESC, p_partkey % 3 DESC, p_retailprice, p_partkey::VARCHAR) AS s FROM part), a AS (SELECT id, s::INTEGER AS pos FROM r WHERE s <= 5), b AS (SELECT id, (5 + row_number() OVER (ORDER BY id::BIGINT % 3 DESC, m, id))::INTEGER AS pos FROM r WHERE s > 5) SELECT * FROM a UNION ALL SELECT * FROM b WHERE pos <= 12")
def smart_fast_topk(t):
    k = F.col("p_partkey")
    rows = t("part").select(k.cast("string").alias("id"), F.col("p_size").alias("context_length"), (k % 7).alias("max_output"), (k % 5).alias("parameters"), (k % 3).alias("successes"), F.col("p_retailprice").alias("median_ms"))
    return R.smart_then_fast(rows, 5, 12)


@query("SELECT event_type AS name, count(*) AS calls, count(*) FILTER (value > 50) AS ok, round(avg(value), 6) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms, max_by(props, event_id) AS last_details FROM events GROUP BY 1")
def phase_profile(t):
    rows = t("events").select(F.col("event_type").alias("name"), (F.col("value") > 50).alias("ok"), F.col("value").alias("duration_ms"), F.col("props").alias("details"), F.col("event_id").alias("seq"))
    return M.phase_profile(rows).withColumn("avg_ms", F.round("avg_ms", 6))


@query("SELECT user_id, count(*) AS attempts, count(*) FILTER (event_type <> 'error') AS successes, round(sum(value) FILTER (event_type <> 'error'), 6) AS total_ms, (list_sort(list(value) FILTER (event_type <> 'error')))[len(list(value) FILTER (event_type <> 'error')) // 2 + 1] AS median_ms FROM events GROUP BY user_id")
def attempt_stats(t):
    rows = t("events").select("user_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"))
    return M.attempt_stats(rows, "user_id").select("user_id", "attempts", "successes", F.round("total_ms", 6).alias("total_ms"), "median_ms")


@query("WITH v AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY user_id) SELECT user_id, v[round((len(v) - 1) * 0.5)::INT + 1] AS median, v[round((len(v) - 1) * 0.75)::INT + 1] AS p75, v[round((len(v) - 1) * 0.9)::INT + 1] AS p90, v[len(v)] AS max, (v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2 AS middle, v[len(v) // 2 + 1] AS upper FROM v")
def diff_stats(t):
    rows = t("events").groupBy("user_id").agg(F.collect_list("value").alias("v"))
    return rows.select("user_id", L.diff_stats(F.col("v")).alias("s"), M.middle(F.col("v")).alias("middle"), M.upper_middle(F.col("v")).alias("upper")).select("user_id", "s.*", "middle", "upper")


@query("SELECT user_id, event_id, ts FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3")
def latest_rows(t):
    w = t("events").select("user_id", "event_id", "ts").withColumn("order", F.struct("ts", "event_id"))
    return L.numbered(w, "user_id", "order", 3).select("user_id", "event_id", "ts")


# the cache

def _cache(t) -> DataFrame:
    at = _ms()
    rows = t("events").select(F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("key"), F.col("props").alias("value"), (F.length("props") * 100 + F.col("user_id") % 100).alias("size_bytes"), at.alias("created_at"), at.alias("last_accessed_at"), F.when(F.col("user_id") % 3 > 0, at + F.col("user_id") * 100_000).alias("expires_at"))
    return rows


_S_CACHE = "WITH c AS (SELECT event_type AS kind, event_id::VARCHAR AS key, length(props) * 100 + user_id % 100 AS size_bytes, epoch_us(ts) // 1000 AS last_accessed_at, CASE WHEN user_id % 3 > 0 THEN epoch_us(ts) // 1000 + user_id * 100000 END AS expires_at FROM events) "


@query(_S_CACHE + "SELECT count(*) FILTER (kind = 'click') AS click, count(*) FILTER (kind = 'view') AS view, count(*) AS total, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM c")
def cache_stats(t):
    return C.stats(_cache(t), ("click", "view"))


@query(_S_CACHE + "SELECT kind, key FROM (SELECT *, sum(size_bytes) OVER (ORDER BY last_accessed_at DESC, kind, key ROWS UNBOUNDED PRECEDING) AS held FROM c) WHERE held <= 500000")
def cache_lru(t):
    return C.within_size(_cache(t), 500_000).select("kind", "key")


@query(_S_CACHE + f"SELECT kind, key, CASE WHEN expires_at IS NOT NULL AND expires_at <= {NOW} THEN 'expired' ELSE 'hit' END AS status FROM c WHERE hash(0) = hash(0) AND key::BIGINT % 2 = 0 UNION ALL SELECT kind, key || 'x', 'miss' FROM c WHERE key::BIGINT % 2 = 1")
def cache_ttl(t):
    own = _cache(t).select("kind", "key")
    wanted = own.select("kind", F.when(F.col("key").cast("long") % 2 == 0, F.col("key")).otherwise(F.concat("key", F.lit("x"))).alias("key"))
    return C.read(_cache(t), wanted, NOW).select("kind", "key", "status")


@query(_S_CACHE + f"SELECT kind, count(*) AS n FROM c WHERE expires_at IS NULL OR expires_at > {NOW} GROUP BY kind")
def cache_sweep(t):
    none = _cache(t).select("kind", "key", "value", "size_bytes", F.lit(0).cast("long").alias("ttl_ms")).limit(0)
    return C.written(_cache(t), none, NOW).groupBy("kind").agg(F.count("*").alias("n"))


# the media cache and lookups

_S_MEDIA = f"""WITH p AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 'ftp' ELSE 'https' END || '://media.example/' || p_partkey AS url FROM part),
i AS (SELECT url, p_size * 1000 AS size, md5(p_name) AS sum, {NOW} - p_partkey * 1000 AS used, CASE WHEN p_partkey % 3 = 0 THEN {NOW} + (p_size - 25) * 1000 END AS ends FROM p WHERE p_partkey % 4 > 0),
f AS (SELECT url, p_size * 1000 + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS size, md5(CASE WHEN p_partkey % 13 = 0 THEN p_type ELSE p_name END) AS sum FROM p WHERE p_partkey % 5 > 0) """


def _media(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, name = F.col("p_partkey"), F.md5("p_name")
    url = F.concat(F.when(k % 7 == 0, "ftp").otherwise("https"), F.lit("://media.example/"), k)
    parts = t("part").withColumns({"url": url, "used": NOW - k * 1000, "size": (F.col("p_size") * 1000).cast("long")})
    index = parts.where(k % 4 > 0).select("url", F.col("size").alias("size_bytes"), name.alias("sha256"), F.col("used").alias("created_at"), F.col("used").alias("last_accessed_at"), F.when(k % 3 == 0, NOW + (F.col("p_size") - 25).cast("long") * 1000).alias("expires_at"))
    files = parts.where(k % 5 > 0).select("url", (F.col("size") + F.when(k % 11 == 0, 1).otherwise(0)).alias("size_bytes"), F.when(k % 13 == 0, F.md5("p_type")).otherwise(name).alias("sha256"))
    return parts.select("url"), index, files


def _s_media_get(differs: str) -> str:
    return _S_MEDIA + f"SELECT p.url, CASE WHEN p.url LIKE 'ftp%' THEN 'unfit' WHEN i.url IS NULL THEN 'miss' WHEN ends <= {NOW} THEN 'expired' WHEN f.url IS NULL THEN 'gone' WHEN {differs} THEN 'changed' ELSE 'hit' END AS status FROM p LEFT JOIN i ON i.url = p.url LEFT JOIN f ON f.url = p.url"


@query(_s_media_get("i.size <> f.size"))
def media_cache_get(t):
    wanted, index, files = _media(t)
    return D.read(index, files, wanted, NOW).select("url", "status")


@query(_s_media_get("i.sum <> f.sum"))
def media_cache_verify(t):
    wanted, index, files = _media(t)
    return D.read(index, files, wanted, NOW, "hash").select("url", "status")


@query(_S_MEDIA + f"SELECT url, used FROM (SELECT *, sum(size) OVER (ORDER BY used DESC, url ROWS UNBOUNDED PRECEDING) AS held FROM (SELECT url, size, used FROM i WHERE (ends IS NULL OR ends > {NOW}) AND url NOT IN (SELECT url FROM f WHERE url NOT LIKE 'ftp%' AND size <= 400000) UNION ALL SELECT url, size, {NOW} FROM f WHERE url NOT LIKE 'ftp%' AND size <= 400000)) WHERE held <= 400000")
def media_cache_put(t):
    _, index, files = _media(t)
    return D.written(index, files, NOW, 400_000).select("url", F.col("last_accessed_at").alias("used"))


@query("WITH w AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN min(event_id) END AS episode FROM events GROUP BY 1) SELECT user_id AS show_id, track_id FROM (SELECT w.user_id, e.event_id AS track_id, row_number() OVER (PARTITION BY w.user_id ORDER BY coalesce(e.event_id = w.episode, false) DESC, CASE WHEN e.event_id % 3 > 0 THEN e.ts END DESC NULLS LAST, e.event_id) AS n FROM w JOIN events e ON e.user_id = w.user_id) WHERE n = 1")
def episode_lookup(t):
    wanted = t("events").groupBy(F.col("user_id").alias("show_id")).agg(F.min("event_id").alias("e")).select("show_id", F.when(F.col("show_id") % 2 == 0, F.col("e")).alias("episode_id"))
    episodes = t("events").select(F.col("user_id").alias("show_id"), F.col("event_id").alias("track_id"), F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("released"), F.col("event_id").alias("pos"), F.concat(F.lit("https://media.example/"), "event_id").alias("url"))
    return D.looked_up_episodes(wanted, episodes).select("show_id", "track_id")


@query("WITH w AS (SELECT p_size AS id, min(p_brand) AS series, max(p_type) AS episode FROM part GROUP BY 1) SELECT id, p_type AS title, url FROM (SELECT w.id, p_type, 'u' || p_partkey AS url, row_number() OVER (PARTITION BY w.id ORDER BY p_type = episode AND p_brand = series DESC, p_type = episode DESC, p_partkey) AS n FROM w JOIN part ON p_size = w.id WHERE p_partkey % 4 > 0) WHERE n = 1")
def episode_search(t):
    wanted = t("part").groupBy(F.col("p_size").alias("id")).agg(F.concat(F.lit(" "), F.upper(F.min("p_brand")), F.lit("!")).alias("show"), F.lower(F.max("p_type")).alias("episode"))
    results = t("part").select(F.col("p_size").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("title"), F.col("p_brand").alias("collection"), F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit("u"), "p_partkey")).alias("url"))
    return D.searched_episodes(wanted, results)


@query("SELECT conv_id, turn, nullif(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '') AS said FROM conversations WHERE turn % 4 < 3 UNION ALL SELECT conv_id, turn, NULL FROM conversations WHERE turn % 4 = 3")
def transcript_payloads(t):
    said, shape = F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " "), F.col("turn") % 4
    record, other = F.struct(said.alias("text")), F.struct(F.lit(1).alias("text"))
    raw = F.when(shape == 0, F.to_json(record)).when(shape == 1, F.get_json_object(F.to_json(F.struct(F.array(record, F.struct(F.lit("  ").alias("text"))).alias("x"))), "$.x")).when(shape == 2, F.regexp_extract(F.to_json(record), r'(?s)\A\{"text":(.*)\}\z', 1)).otherwise(F.to_json(other))
    return t("conversations").select("conv_id", "turn", V.transcript_payload(raw).alias("said"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'a/x' WHEN l_linestatus = 'O' THEN 'cli/two|cli/one/m|a/x' ELSE 'cli/one/m|cli/two|a/x' END AS chain, CASE WHEN l_quantity <= 25 THEN 0.5 END::DOUBLE AS temperature, CASE WHEN l_returnflag = 'R' THEN 'google/gemini-2.5-flash' END AS next FROM lineitem")
def local_models_first(t):
    chain = V.with_local_models(F.array(F.lit("a/x")), F.array(F.lit("one"), F.lit("two")), F.create_map(F.lit("one"), F.lit(" m ")), F.when(F.col("l_linestatus") == "O", "two"), F.col("l_returnflag") != "A")
    model = F.when(F.col("l_quantity") <= 25, "gpt-50").otherwise("GPT-5-mini")
    trial = F.when(F.col("l_returnflag") == "R", " Google/Gemini-3-Preview").when(F.col("l_returnflag") == "N", "google/gemini-2.5-flash")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.array_join(chain, "|").alias("chain"), V.temperature_for(F.lit("openai"), model, F.lit(0.5)).alias("temperature"), V.model_after_empty(trial).alias("next"))


@query("SELECT page_id, regexp_matches(lower(substr(html, 1, 20000)), 'access denied|attention required|captcha|cloudflare|enable javascript|forbidden|please turn javascript on|verify you are human') AS blocked, ['/s/' || page_id || '/a.png', '/s/' || page_id || '/slides.json'] AS slides FROM pages")
def blocked_pages(t):
    folder = F.concat(F.lit("/s/"), "page_id")
    record = F.to_json(F.struct(F.concat(folder, F.lit("/")).alias("slidesDir"), F.array(F.struct(F.concat(folder, F.lit("/a.png")).alias("imagePath")), F.struct(F.lit("/s/b.png").alias("imagePath")), F.struct(F.concat(folder, F.lit("/../b.png")).alias("imagePath"))).alias("slides")))
    return t("pages").select("page_id", V.looks_blocked(F.col("html")).alias("blocked"), D.slide_files(record).alias("slides"))


# timelines

@query("WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 / 1000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), k AS (SELECT user_id, t, n, t AS prior, true AS kept FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.t, e.n, CASE WHEN e.t - k.prior >= 40000 THEN e.t ELSE k.prior END, e.t - k.prior >= 40000 FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1) SELECT user_id, count(*) AS kept, max(t) AS last FROM k WHERE kept GROUP BY user_id")
def min_gap(t):
    rows = t("events").groupBy("user_id").agg(F.collect_list(_ms() / 1000.0).alias("v")).select("user_id", L.min_duration(F.col("v"), 40000).alias("k"))
    return rows.select("user_id", F.size("k").cast("long").alias("kept"), F.element_at("k", -1).alias("last"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT (epoch_us(ts) // 1000)::DOUBLE AS t FROM events), k AS (SELECT min(t) AS t FROM e UNION ALL SELECT (SELECT min(e.t) FROM e WHERE e.t >= k.t + 7200000) FROM k WHERE k.t IS NOT NULL)
SELECT 'all' AS medium, t AS kept_at FROM k WHERE t IS NOT NULL""")
def gap_chain(t):
    return N.thinned(t("events").select(F.lit("all").alias("medium"), _ms().alias("kept_at")), "medium", "kept_at", 7_200_000)


@query()
def slide_plan(t):
    day = F.datediff("ts", F.lit("2024-01-01"))
    media = t("events").where(F.col("event_type") != "error").groupBy("user_id").agg(F.array_sort(F.collect_list((day * 60 + F.col("value")).cast("double"))).alias("scenes"), F.max(F.when(F.col("user_id") % 5 > 0, day * 60.0 + 90)).alias("duration"))
    return L.slide_plan(media, "user_id", 15.0, 40)


@query("SELECT e.user_id, e.at, s.at AS start FROM (SELECT user_id, (epoch_us(ts) // 1000)::DOUBLE AS at FROM events WHERE event_type = 'view') e ASOF LEFT JOIN (SELECT user_id, (epoch_us(ts) // 1000)::DOUBLE AS at FROM events WHERE event_type = 'click') s ON e.user_id = s.user_id AND e.at >= s.at")
def scene_asof(t):
    rows = t("events").select("user_id", _ms().cast("double").alias("at"), "event_type")
    return L.asof_segments(rows.where("event_type = 'view'"), rows.where("event_type = 'click'").select("user_id", F.col("at").alias("start")), "user_id")


@query("SELECT s.user_id, s.i AS index, count(e.at) AS n FROM (SELECT user_id, event_id AS i, epoch_us(ts) // 1000 / 1000.0 AS at, lead(epoch_us(ts) // 1000 / 1000.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'click') s LEFT JOIN (SELECT user_id, epoch_us(ts) // 1000 / 1000.0 AS at FROM events WHERE event_type = 'view') e ON e.user_id = s.user_id AND e.at >= greatest(floor(s.at) - 6, 0) AND e.at <= CASE WHEN floor(nxt) > floor(s.at) THEN least(floor(s.at) + 40000, floor(nxt)) ELSE floor(s.at) + 40000 END GROUP BY ALL")
def slide_window(t):
    rows = t("events").select("user_id", F.col("event_id").alias("index"), (_ms() / 1000.0).alias("at"), "event_type")
    slides = rows.where("event_type = 'click'").drop("event_type")
    said = rows.where("event_type = 'view'").select("user_id", F.col("at").alias("start"), F.col("index").alias("pos"), F.lit("x").alias("text"))
    texts = L.slide_texts(slides, said, "user_id", 40_000, 1_000_000)
    return texts.select("user_id", "index", F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("long").alias("n"))


@query("SELECT user_id, event_id, before, behind FROM (SELECT user_id, event_id, event_type, lag(event_id) OVER w AS before, lead(event_id) OVER w AS behind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'click'")
def neighbours(t):
    return L.neighbours(t("events"), "user_id", "event_id").where("event_type = 'click'").select("user_id", "event_id", "before", "behind")


@query("SELECT user_id, event_id, value AS top FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR value > m")
def monotone_progress(t):
    return L.monotone_progress(t("events"), "user_id", "event_id", "value").select("user_id", "event_id", "top")


@query("SELECT a.vec_id, (len(list_filter(list_zip(a.bits, b.bits), lambda x: x[1] <> x[2])) / 64.0)::DOUBLE AS distance FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE >= list_avg(list_transform(embedding, lambda y: y::DOUBLE))) AS bits FROM embeddings) a JOIN (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE >= list_avg(list_transform(embedding, lambda y: y::DOUBLE))) AS bits FROM embeddings) b ON b.vec_id = a.vec_id - 1")
def hash_distance(t):
    bits = t("embeddings").select("vec_id", clock.average_hash(F.col("embedding")).alias("bits"))
    other = bits.select((F.col("vec_id") + 1).alias("vec_id"), F.col("bits").alias("before"))
    return bits.join(other, "vec_id").select("vec_id", clock.hash_distance(F.col("before"), F.col("bits")).alias("distance"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(t):
    rows = t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def payload_fields(t):
    return t("events").select("event_type", payloads.field(payloads.parsed(F.col("props")), "$.k", "bigint").alias("k")).groupBy("event_type").agg(F.sum("k").alias("k"))


# routing

_RULES = [(0, 0, ["website"], None, 300, ["a/small"]), (0, 1, ["website"], None, 900, ["a/mid", "b/mid"]), (1, 0, None, None, None, ["c/large"])]


def _routed(t) -> DataFrame:
    docs = t("documents").select(F.col("doc_id").alias("id"), F.lit("website").alias("kind"), T.token_estimate(F.col("text")).cast("long").alias("tokens"))
    rules = docs.sparkSession.createDataFrame(_RULES, "rule int, band int, kinds array<string>, low long, high long, candidates array<string>")
    return R.rule_candidates(docs, rules).join(docs.select("id", "tokens"), "id")


@query("WITH d AS (SELECT doc_id AS id, ceil(length(text) / 4)::BIGINT AS n FROM documents) SELECT id, 0 AS pos, CASE WHEN n <= 300 THEN 'a/small' WHEN n <= 900 THEN 'a/mid' ELSE 'c/large' END AS candidate FROM d UNION ALL SELECT id, 1, 'b/mid' FROM d WHERE n > 300 AND n <= 900")
def route_candidates(t):
    return _routed(t).select("id", "pos", "candidate")


@query("WITH d AS (SELECT doc_id AS id, ceil(length(text) / 4)::BIGINT AS n FROM documents) SELECT id, 0 AS pos, 'xai/one' AS model FROM d WHERE n <= 700 UNION ALL SELECT id, CASE WHEN n <= 700 THEN 1 ELSE 0 END, 'openai/two' FROM d")
def model_attempts(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), T.token_estimate(F.col("text")).cast("long").alias("tokens"))
    cand = docs.select("id", "tokens", F.posexplode(F.array(F.lit("xai/one"), F.lit("two"), F.lit("openai/two"))).alias("pos", "candidate"))
    limits = docs.sparkSession.createDataFrame([("xai/one", 700)], "model string, max_input_tokens long")
    return R.attempts(cand, limits).select("id", "pos", "model")


@query("WITH m AS (SELECT DISTINCT lower(p_brand) AS s FROM part) SELECT 'openai/' || s AS model, CASE WHEN s LIKE '%1' THEN 'OpenAI/' || s WHEN s LIKE '%2' THEN 'other/' || s WHEN s LIKE '%3' THEN 'x/' || replace(s, '#', '-') END AS gateway FROM m")
def catalog_match(t):
    brands = t("part").select(F.lower("p_brand").alias("s")).distinct()
    s = F.col("s")
    ids = brands.select(F.explode(F.when(s.endswith("1"), F.array(F.concat(F.lit("OpenAI/"), s), F.concat(F.lit("z/"), s))).when(s.endswith("2"), F.array(F.concat(F.lit("other/"), s))).when(s.endswith("3"), F.array(F.concat(F.lit("x/"), F.replace(s, F.lit("#"), F.lit("-"))))).otherwise(F.array(F.concat(F.lit("p/"), s), F.concat(F.lit("q/"), s)))).alias("id"))
    return R.gateway_ids(brands.select(F.concat(F.lit("openai/"), s).alias("model")), ids)


for _name, (_fn, _sql) in GOLDENS.items():
    QUERIES[_name] = _fn
    ORACLES[_name] = _sql
