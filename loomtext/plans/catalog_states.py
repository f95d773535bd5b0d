"""Registered queries of cache states, model lists and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import clock, markdown as MD, text as T
from loomtext.operators import cache as C, metrics as M, routing as R, streams as S
from loomtext.plans.registry import query


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'bypassed' WHEN event_id % 3 = 0 THEN 'miss' WHEN event_id % 7 = 0 THEN 'expired' WHEN event_id % 2 = 0 AND event_type <> 'click' THEN 'miss' ELSE 'hit' END AS status FROM events""")
def transcript_reads(t):
    k = F.col("event_id")
    status = C.transcript_read(F.when(k % 5 == 0, "bypass").otherwise("default"), k % 3 > 0, k % 7 == 0, F.col("event_type") == "click", k % 2 == 0)
    return t("events").select("event_id", status.alias("status"))


@query("""SELECT event_id, CASE WHEN event_id % 4 > 1 THEN 604800000 ELSE 21600000 END AS ttl_ms FROM events WHERE event_id % 6 <> 0 AND event_id % 9 <> 0""")
def transcript_writes(t):
    k = F.col("event_id")
    rows = t("events").select("event_id", F.when(k % 4 > 1, F.col("props")).when(k % 4 == 1, "").alias("value"), F.when(k % 2 == 0, k % 6 == 0).alias("transient"), F.when(k % 3 == 0, k % 9 != 0).alias("cacheable"))
    return C.transcript_writes(rows).select("event_id", F.col("ttl_ms").cast("int").alias("ttl_ms"))


@query("""SELECT event_type AS kind, event_id::VARCHAR AS key, CASE WHEN event_id % 4 = 0 THEN 'fresh' WHEN event_id % 3 = 0 THEN props END AS value, CASE WHEN event_id % 4 > 0 AND event_id % 3 = 0 THEN 'fallback' ELSE 'miss' END AS status FROM events""")
def stale_fallback(t):
    k = F.col("event_id")
    rows = t("events").select(F.col("event_type").alias("kind"), k.cast("string").alias("key"), "event_id", "props")
    fresh = rows.select("kind", "key", F.when(k % 4 == 0, "fresh").alias("value"), F.lit("miss").alias("status"))
    return C.with_stale_fallback(fresh, rows.where(k % 3 == 0).select("kind", "key", F.col("props").alias("value")))


@query("""WITH c AS (SELECT p_partkey::VARCHAR AS key, p_name AS value FROM part WHERE p_partkey % 3 = 0),
r AS (SELECT o_orderkey AS id, (o_orderkey % 500)::VARCHAR AS selection_key FROM orders),
h AS (SELECT l_orderkey AS id, min(l_linenumber * 1000000 + l_partkey) AS pos, min_by(value, l_linenumber * 1000000 + l_partkey) AS value FROM lineitem JOIN c ON c.key = l_partkey::VARCHAR GROUP BY 1)
SELECT r.id, coalesce(c.value, h.value) AS value, CASE WHEN c.value IS NULL THEN h.pos END AS pos FROM r LEFT JOIN c ON c.key = r.selection_key LEFT JOIN h ON h.id = r.id""")
def summary_cache(t):
    cache = t("part").where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("value"))
    requests = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 500).cast("string").alias("selection_key"))
    candidates = t("lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"), F.col("l_partkey").cast("string").alias("key"))
    return C.first_cached(requests, candidates, cache)


@query("SELECT count(*) FILTER (event_type = 'click') AS scraper, count(*) FILTER (event_type = 'view') AS reader, 0::BIGINT AS other FROM events")
def service_counts(t):
    host = F.when(F.col("event_id") % 9 > 0, F.concat(F.upper("event_type"), F.lit(".example"))).otherwise(F.concat("event_type", F.lit(".EXAMPLE")))
    return M.service_requests(t("events"), host, {"scraper": "click.example", "reader": "view.example", "other": "none.example"})


@query("SELECT event_id, round((1 - abs(value - 128) / 128) * 0.5 + least(value / 2 / 64, 1) * 0.5, 9) AS quality FROM events")
def frame_quality(t):
    return t("events").select("event_id", F.round(clock.frame_quality(F.col("value"), F.col("value") / 2), 9).alias("quality"))


@query("""SELECT c_custkey, sha256('{"p0":' || c_custkey || ',"p1":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || ',"p2":true}') AS digest FROM customer""")
def cache_keys(t):
    return t("customer").select("c_custkey", T.cache_key(F.col("c_custkey"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")), F.lit(True)).alias("digest"))


@query("""SELECT p_partkey FROM part WHERE p_partkey % 2 = 0 AND p_size % 40 <= 30 AND (p_partkey % 4 = 0 OR p_size >= 20)""")
def free_model_list(t):
    k, now = F.col("p_partkey"), 1_700_000_000_000
    names = F.concat(F.lit("org/m-"), F.when(k % 4 > 0, F.concat(F.col("p_size").cast("string"), F.lit("b"))).otherwise("large"), F.when(k % 2 == 0, ":free").otherwise(""))
    rows = t("part").select("p_partkey", names.alias("id"), (now - (F.col("p_size") % 40).cast("long") * 86_400_000).alias("created_ms"))
    return R.free_models(rows, now, 30, 20.0).select("p_partkey")


@query("SELECT p_brand AS id, min(CASE WHEN p_partkey % 3 = 0 THEN 'catalog' ELSE 'local' END) AS source FROM part WHERE p_partkey % 5 > 0 GROUP BY p_brand")
def model_picker(t):
    k = F.col("p_partkey")
    return R.picker(t("part").select(F.when(k % 3 == 0, "catalog").otherwise("local").alias("source"), F.when(k % 5 > 0, F.concat(F.lit(" "), "p_brand", F.lit(" "))).otherwise("  ").alias("id")))


@query("""WITH f AS (SELECT l_returnflag || l_linestatus AS model, list_sort(list(DISTINCT 'p' || l_linenumber)) AS providers FROM lineitem WHERE l_linenumber > CASE l_returnflag WHEN 'A' THEN 4 ELSE 0 END GROUP BY 1)
SELECT model, array_to_string(providers, ',') AS providers, array_to_string(providers[1:3], ', ') || CASE WHEN len(providers) > 3 THEN ' (+' || (len(providers) - 3) || ' more)' ELSE '' END AS label FROM f""")
def failed_providers(t):
    rows = t("lineitem").where(F.col("l_linenumber") > F.when(F.col("l_returnflag") == "A", 4).otherwise(0))
    p = F.concat(F.lit("p"), F.col("l_linenumber").cast("string"))
    out = R.provider_union(rows.select(F.concat("l_returnflag", "l_linestatus").alias("model"), F.array(p, p).alias("providers")))
    return out.select("model", F.array_join("providers", ",").alias("providers"), "label")


@query("""WITH RECURSIVE e AS (SELECT event_type, epoch_us(ts) // 1000 AS pos, event_id FROM events), f AS (SELECT event_type, min(pos) AS pos FROM e GROUP BY event_type UNION ALL SELECT f.event_type, (SELECT min(e.pos) FROM e WHERE e.event_type = f.event_type AND e.pos >= f.pos + 40000000) FROM f WHERE f.pos IS NOT NULL)
SELECT f.event_type, f.pos AS shown_at, min(event_id) AS event_id FROM f JOIN e USING (event_type, pos) GROUP BY ALL""")
def throttled_updates(t):
    rows = t("events").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("shown_at"), "event_id")
    return S.throttled(rows, "event_type", "shown_at", "event_id", 40_000_000)


@query("""WITH c AS (SELECT conv_id, turn, role, '[slide:' || (turn + 1) || ']' || CASE WHEN turn % 2 = 0 THEN chr(10) || role || ' ' || turn WHEN turn % 3 > 0 THEN chr(10) || 'said ' || turn ELSE '' END AS block FROM conversations)
SELECT conv_id, 'Intro ' || conv_id || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY turn) AS said FROM c GROUP BY conv_id""")
def slides_with_fallback(t):
    k = F.col("turn")
    rows = t("conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(k % 2 == 0, F.struct(k, F.concat(F.lit("[slide:"), k + 1, F.lit("]\n"), "role", F.lit(" "), k).alias("b"))))).alias("own"),
        F.map_from_entries(F.collect_list(F.when((k % 2 > 0) & (k % 3 > 0), F.struct((k + 1).cast("int"), F.concat(F.lit("said "), k))))).alias("heard"), F.count("*").cast("int").alias("n"),
    )
    text = F.concat(F.lit("Intro "), F.col("conv_id"), F.lit("\n\n"), F.array_join(F.transform("own", lambda x: x["b"]), "\n"))
    return rows.select("conv_id", MD.with_slides_col(text, F.col("n"), F.col("heard")).alias("said"))
