"""Chains of services: each step is asked only about the rows that are still open.

After each step the open rows are stored with its answers, so a service is asked once
about a row, and only the rows it leaves open go on to the next step. Nothing is shuffled by the chain
itself: a row carries what is known of it, its notes and the names of those asked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomtext.sources.stored import stored

Service = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Step:
    """``service`` takes open rows and returns them with any of ``value`` (text that
    settles a row; blank counts as none), ``settled`` (no more is asked about it),
    ``note`` and the chain's facts. ``asked``: about which rows; null counts as no. A
    ``quiet`` step looks something up and is not listed among those attempted."""

    name: str
    service: Service
    asked: Column | None = None
    quiet: bool = False


def resolve(rows: DataFrame, steps: list[Step], facts: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``value``, ``provider`` (the step it comes from), ``attempted``,
    ``notes``, ``settled`` and ``facts`` (name to type). Rows that no step settles have
    no value. ``rows`` must not have columns of these names, nor ``note``."""
    none = lambda kind: F.lit(None).cast(kind)
    start = {"value": none("string"), "provider": none("string"), "attempted": F.array().cast("array<string>"), "notes": F.array().cast("array<string>"), "settled": F.lit(False)}
    kinds = (facts or {}) | {"value": "string", "settled": "boolean", "note": "string"}
    columns = [*rows.columns, *start, *(facts or {})]
    opened = rows.withColumns(start | {k: none(v) for k, v in (facts or {}).items()}).select(columns)
    ended = []
    for step in steps:
        asked = F.coalesce(step.asked, F.lit(False)) if step.asked is not None else F.lit(True)
        answered = step.service(opened.where(asked).withColumn("note", none("string")))
        answered = answered.withColumns({k: F.col(k).cast(v) for k, v in kinds.items()})
        answered = answered.withColumns(
            {
                "value": F.when(F.trim("value") != "", F.col("value")), "settled": F.coalesce("settled", F.lit(False)),
                "notes": F.when(F.col("note").isNull(), F.col("notes")).otherwise(F.concat("notes", F.array("note"))),
                "attempted": F.col("attempted") if step.quiet else F.concat("attempted", F.array(F.lit(step.name))),
            }
        ).select(columns)
        answered = answered.withColumns({"provider": F.when(F.col("value").isNotNull(), F.lit(step.name)), "settled": F.col("settled") | F.col("value").isNotNull()})
        # one table of answered and other open rows, so that neither plans nor partitions add up over the steps
        after = stored(answered if step.asked is None else answered.unionByName(opened.where(~asked)))
        ended.append(after.where("settled"))
        opened = after.where("not settled")
    for part in ended:
        opened = opened.unionByName(part)
    return opened


def ledger(resolved: DataFrame) -> DataFrame:
    """(step, asked, resolved): how many rows each step was asked about and had a value for."""
    rows = resolved.select(F.explode("attempted").alias("step"), "provider")
    return rows.groupBy("step").agg(F.count("*").alias("asked"), F.count_if(F.col("provider") == F.col("step")).alias("resolved"))


def joined(answers: DataFrame, key: str) -> Service:
    """A service whose answers are a table by ``key``, one row each: its other columns
    take the place of the rows' own; rows without an answer get nulls."""
    names = [c for c in answers.columns if c != key]

    def ask(rows: DataFrame) -> DataFrame:
        own = answers.select(F.col(key).alias("key_"), *(F.col(c).alias(f"{c}_") for c in names))
        found = rows.join(own, F.col(key) == F.col("key_"), "left")
        return found.withColumns({c: F.col(f"{c}_") for c in names}).drop("key_", *(f"{c}_" for c in names))

    return ask
