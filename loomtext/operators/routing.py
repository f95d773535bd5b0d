"""Model routing: rules, catalogs, attempts, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtext.functions import options, text as T

MOST_RULES = 1000


def rule_candidates(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, pos, candidate) for ``requests`` (id, kind, tokens).

    ``rules`` (rule, band, kinds array, low, high, candidates array) are in order
    of rule and band; a rule without kinds is for all, a band without bounds for
    any count. Of each request's first fitting rule and band the candidates are
    returned. Rules are a configuration: they are read on the driver, up to
    ``MOST_RULES`` of them, and become one expression, so there is no join."""
    found = rules.orderBy("rule", "band").limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    chosen = F.lit(None).cast("array<string>")
    for r in reversed(found):
        fits = F.col("kind").isin(*r["kinds"]) if r["kinds"] else F.lit(True)
        if r["low"] is not None or r["high"] is not None:
            fits = fits & F.col("tokens").between(r["low"] or 0, (1 << 62) if r["high"] is None else r["high"])
        chosen = F.when(F.coalesce(fits, F.lit(False)), F.array(*map(F.lit, r["candidates"]))).otherwise(chosen)
    return requests.select("id", F.posexplode(chosen).alias("pos", "candidate"))


def _slug(model: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(model, "^[^/]*/(.*)$", 1)), "[^a-z0-9]+", "")


def gateway_ids(models: DataFrame, catalog: DataFrame) -> DataFrame:
    """``models`` (model) with ``gateway``: the catalog's (id) equal id, else the
    only one with the name behind the slash, else with its letters and digits."""
    ids = catalog.select(F.trim("id").alias("gateway")).where(F.contains("gateway", F.lit("/")))
    low, name = F.lower("gateway"), F.lower(F.regexp_extract("gateway", "^[^/]*/(.*)$", 1))
    exact = ids.groupBy(low.alias("key")).agg(F.min("gateway").alias("g1"))

    def only(key: Column, out: str) -> DataFrame:
        return ids.where(key != "").groupBy(key.alias("key")).agg(F.count_distinct(low).alias("n"), F.min("gateway").alias(out)).where("n = 1").drop("n")

    rows = models.withColumn("canonical_", F.lower(options.model_id(F.col("model"))))
    keys = {"g1": F.col("canonical_"), "g2": F.regexp_extract("canonical_", "^[^/]*/(.*)$", 1), "g3": _slug(F.col("canonical_"))}
    for out, table in (("g1", exact), ("g2", only(name, "g2")), ("g3", only(_slug(F.col("gateway")), "g3"))):
        rows = rows.join(table.withColumnRenamed("key", f"{out}_key"), keys[out] == F.col(f"{out}_key"), "left").drop(f"{out}_key")
    return rows.withColumn("gateway", F.coalesce("g1", "g2", "g3")).drop("g1", "g2", "g3", "canonical_")


def attempts(candidates: DataFrame, limits: DataFrame, gateways: DataFrame | None = None, keys: tuple[str, ...] = (), video: bool = False) -> DataFrame:
    """(id, pos, transport, model, required, has_key) of ``candidates`` (id, pos,
    candidate, tokens), in order and without repeats.

    A model whose ``limits`` (model, max_input_tokens) the tokens exceed is left
    out, as is one that cannot see where ``video`` is asked for, and a command
    without its key. With ``gateways`` (model, gateway) each native model is
    followed by its id there."""
    low = F.lower("candidate")
    kind = F.when(low.startswith("cli/"), "cli").when(low.startswith("openrouter/"), "openrouter").otherwise("native")
    rows = candidates.withColumn("transport", kind).withColumn("model", F.when(kind == "native", options.model_id(F.col("candidate"))).otherwise(F.col("candidate"))).withColumn("step", F.lit(0))
    if video:
        rows = rows.where((F.col("transport") == "native") & F.lower("model").startswith("google/gemini-"))
    elif gateways is not None:
        native = rows.where("transport = 'native'").join(gateways.where("gateway is not null").select(F.col("model").alias("candidate"), "gateway"), "candidate")
        more = native.withColumns({"model": F.concat(F.lit("openrouter/"), F.col("gateway")), "transport": F.lit("openrouter"), "step": F.lit(1)})
        rows = rows.unionByName(more.drop("gateway"))
    listed = F.regexp_replace("model", "^openrouter/", "")
    rows = rows.join(limits.select(F.col("model").alias("limit_of"), "max_input_tokens"), listed == F.col("limit_of"), "left")
    over = (F.col("transport") != "cli") & (F.col("max_input_tokens") > 0) & (F.col("tokens") > F.col("max_input_tokens"))
    required = options.required_key(F.col("model"))
    rows = rows.where(F.col("model").isNotNull() & ~F.coalesce(over, F.lit(False))).withColumn("required", required).withColumn("has_key", F.col("required").isin(*keys) if keys else F.lit(False))
    rows = rows.where((F.col("transport") != "cli") | F.col("has_key"))
    first = rows.groupBy("id", "transport", "model").agg(F.min(F.struct("pos", "step")).alias("at"), F.first("required").alias("required"), F.first("has_key").alias("has_key"))
    return first.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("at")) - 1).alias("pos"), "transport", "model", "required", "has_key")


def first_success(results: DataFrame) -> DataFrame:
    """(id, model, value, tried) of the first attempt with a key that succeeded, by ``pos``."""
    return results.groupBy("id").agg(F.min_by(F.when(F.col("ok"), F.col("model")), F.when(F.col("ok"), F.col("pos"))).alias("model"), F.min_by(F.when(F.col("ok"), F.col("value")), F.when(F.col("ok"), F.col("pos"))).alias("value"), F.count("*").alias("tried"))


def chain(rows: DataFrame, providers: tuple[str, ...]) -> DataFrame:
    """``rows`` with value and provider of the first of the providers' columns that has text."""
    said = {p: F.nullif(F.trim(p), F.lit("")) for p in providers}
    name = F.coalesce(*(F.when(said[p].isNotNull(), F.lit(p)) for p in providers))
    tried = F.array_compact(F.array(*(F.when(~F.coalesce(F.array_position(F.array(*map(F.lit, providers)), name) < k + 1, F.lit(False)), F.lit(p)) for k, p in enumerate(providers))))
    return rows.withColumns({"value": F.coalesce(*said.values()), "provider": name, "attempted": tried})


def free_models(catalog: DataFrame, now_ms: int, days: int, least_b: float) -> DataFrame:
    """Free models of at most ``days``, of at least ``least_b`` billion parameters or unknown."""
    age = now_ms - F.col("created_ms")
    return catalog.where(F.col("id").endswith(":free") & age.between(0, days * 86_400_000) & (F.coalesce(T.parameter_billions(F.col("id")), F.lit(1e9)) >= least_b))


def with_metadata(working: DataFrame, catalog: DataFrame) -> DataFrame:
    """``working`` (id, ...) with the context_length, max_output, parameters and modality
    that the catalog has of the id; of repeated ids its last by ``pos``. Ids that the
    catalog lacks have no metadata and 0 parameters."""
    names = ["context_length", "max_output", "parameters", "modality"]
    last = catalog.groupBy("id").agg(F.max_by(F.struct(*names), "pos").alias("m_")).select(F.col("id").alias("i_"), "m_")
    rows = working.join(last, F.col("id") == F.col("i_"), "left").select(*working.columns, *(F.col(f"m_.{n}").alias(n) for n in names))
    return rows.withColumn("parameters", F.coalesce("parameters", F.lit(0)))


def smart_order() -> list[Column]:
    none = lambda c: F.coalesce(F.col(c), F.lit(-1)).desc()
    return [none("context_length"), none("max_output"), none("parameters")]


def smart_then_fast(models: DataFrame, smart: int, most: int) -> DataFrame:
    """(id, pos): the ``smart`` best by size, then the fastest, ``most`` in all, none twice."""
    fast = [F.desc("successes"), F.asc("median_ms"), F.asc("id")]
    rows = models.groupBy("id").agg(*(F.max(c).alias(c) for c in ("context_length", "max_output", "parameters", "successes")), F.min("median_ms").alias("median_ms"))
    by_smart = rows.orderBy(*smart_order(), *fast).limit(min(smart, most)).select("id", F.lit(0).alias("turn"), *models.columns[1:])
    rest = rows.join(by_smart.select("id"), "id", "left_anti").orderBy(*fast).limit(max(0, most - smart))
    first = by_smart.withColumn("pos", F.row_number().over(Window.partitionBy("turn").orderBy(*smart_order(), *fast))).select("id", "pos")
    then = rest.withColumn("turn", F.lit(1)).withColumn("pos", F.row_number().over(Window.partitionBy("turn").orderBy(*fast)) + min(smart, most)).select("id", "pos")
    return first.union(then)


def suggestions(models: DataFrame, most: int = 5) -> DataFrame:
    """Ids by a score that prefers fast, current, released models; ties by place."""
    low = F.lower("id")
    score = F.when(F.contains(low, F.lit("flash")), 0).otherwise(10) + F.when(F.contains(low, F.lit("3")), 0).otherwise(5) + F.when(F.contains(low, F.lit("preview")), 2).otherwise(0)
    return models.withColumn("score", score).orderBy("score", "pos").limit(most)


def provider_union(failures: DataFrame, shown: int = 3) -> DataFrame:
    """(model, providers, label) of ``failures`` (model, providers array): all of them, sorted, the first few by name."""
    rows = failures.select("model", F.explode("providers").alias("p")).groupBy("model").agg(F.array_sort(F.collect_set("p")).alias("providers"))
    more = F.size("providers") - shown
    return rows.withColumn("label", F.concat(F.array_join(F.slice("providers", 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise("")))


def picker(sources: DataFrame) -> DataFrame:
    """Ids of ``sources`` (source, id) by source and name, blank ones and repeats left out."""
    rows = sources.select("source", F.trim("id").alias("id")).where("id <> ''")
    return rows.groupBy("id").agg(F.min("source").alias("source"))
