"""Usage, cost and timing aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def finite(value: Column) -> Column:
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), value)


def usage_by_model(calls: DataFrame, tokens: tuple[str, ...] = ("prompt_tokens", "completion_tokens", "total_tokens")) -> DataFrame:
    """Calls and token sums by provider and model; a sum is null if no call has the figure."""
    return calls.groupBy("provider", "model").agg(F.count("*").alias("calls"), *(F.sum(finite(F.col(t))).alias(t) for t in tokens))


def priced(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """Calls with ``cost``: the explicit one, else tokens at the catalog's prices, else null.
    The catalog is a plain join side; Spark broadcasts it only by its size."""
    rates = pricing.select(F.col("model").alias("model_"), "input_usd_per_token", "output_usd_per_token")
    counted = F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull()
    listed = F.when(counted, F.col("prompt_tokens") * F.col("input_usd_per_token") + F.col("completion_tokens") * F.col("output_usd_per_token"))
    return calls.join(rates, calls["model"] == rates["model_"], "left").withColumn("cost", F.coalesce(finite(F.col("cost_usd")), listed)).drop("model_", "input_usd_per_token", "output_usd_per_token")


def total_cost(calls: DataFrame, pricing: DataFrame, by: list[str], extra: float | None = None) -> DataFrame:
    """Sum of costs by ``by``, with ``extra`` added; null only if nothing is known."""
    sums = priced(calls, pricing).groupBy(*by).agg(F.sum("cost").alias("cost"))
    return sums if extra is None else sums.withColumn("cost", F.coalesce("cost", F.lit(0.0)) + extra)


def estimated_cost(prompt: Column, output: Column, input_price: Column, output_price: Column) -> Column:
    count = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    return count(prompt) * input_price + count(output) * output_price


def audio_cost(seconds: Column, usd_per_minute: float) -> Column:
    return F.when(seconds > 0, seconds / 60 * usd_per_minute)


def service_requests(requests: DataFrame, host: Column, services: dict[str, str]) -> DataFrame:
    """One row: how many requests went to each service's host."""
    return requests.agg(*(F.count_if(F.lower(host) == h).alias(name) for name, h in services.items()))


def phase_profile(events: DataFrame) -> DataFrame:
    """Calls, successes and times by phase, with the details of the last call."""
    return events.groupBy("name").agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
        F.max_by("details", "seq").alias("last_details"),
    )


def middle(values: Column) -> Column:
    """Median with the mean of the two middle values."""
    v, n = F.sort_array(values), F.size(values)
    half = F.floor(n / 2).cast("int")
    return F.when(n == 0, None).when(n % 2 == 1, F.get(v, half)).otherwise((F.get(v, half - 1) + F.get(v, half)) / 2)


def upper_middle(values: Column) -> Column:
    """Median with the upper of two middle values."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def failure_kind(message: Column) -> Column:
    """First kind whose words a message has."""
    m = F.lower(message)
    rate = F.contains(m, F.lit("rate limit exceeded"))
    out = F.when(rate & m.rlike("per-day|per day"), "rate_limit_day").when(rate, "rate_limit_minute").when(m.rlike("no allowed providers|no endpoints"), "no_providers")
    return out.when(m.rlike("timed out|timeout"), "timeout").when(m.rlike("empty summary|empty response"), "empty").when(m.rlike("provider returned error|upstream"), "provider").otherwise("other")


FAILURE_KINDS = ("rate_limit_day", "rate_limit_minute", "no_providers", "timeout", "empty", "provider", "other")


def failure_histogram(messages: DataFrame, column: str) -> DataFrame:
    """One row with a count for every kind, zeros included."""
    kind = failure_kind(F.col(column))
    return messages.select(kind.alias("kind")).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in FAILURE_KINDS))


def is_retryable(message: Column) -> Column:
    return F.coalesce(message.rlike("(?i)timed out|empty summary"), F.lit(False))


def attempt_stats(attempts: DataFrame, by: str) -> DataFrame:
    """Successes and latencies by model; latencies of successful attempts only."""
    good = F.when(F.col("ok"), F.col("latency_ms"))
    out = attempts.groupBy(by).agg(F.count("*").alias("attempts"), F.count_if("ok").alias("successes"), F.sum(good).alias("total_ms"), F.avg(good).alias("avg_ms"), F.collect_list(good).alias("all_"))
    return out.withColumn("median_ms", upper_middle(F.col("all_"))).drop("all_")


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``: partial aggregation, no window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row_"))
    return best.select(*keys, *(F.col("row_")[c].alias(c) for c in rest)).select(rows.columns)
