"""Getting pages: a request's answer, a second attempt, scrapers in order.

The network stays outside; a fetch is a service that adds status, content_type,
final_url, failure and body to the rows it is asked about (``identity`` asks it not to
compress), a scraper one that adds body.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from loomtext.functions import services
from loomtext.operators.chains import Service, Step, resolve

#: Content types of pages; fixed values.
PAGE_TYPES = ("text/html", "application/xhtml+xml", "application/xml", "text/xml", "application/rss+xml", "application/atom+xml")
FACTS = {"status": "int", "content_type": "string", "final_url": "string", "failure": "string", "body": "string", "problem": "string"}


def broken_compression(failure: Column) -> Column:
    return F.coalesce(failure.rlike("(?i)zlib|shortread|short read|decompress"), F.lit(False))


def answer_problem(status: Column, content_type: Column, failure: Column) -> Column:
    """Why an answer is no page, null if it is one. An unnamed content type is taken for a page's."""
    kind = F.lower(F.trim(content_type))
    fits = F.startswith(kind, F.lit("text/"))
    for t in PAGE_TYPES:
        fits = fits | F.contains(kind, F.lit(t))
    late = F.coalesce(failure.rlike("(?i)abort|timed? ?out"), F.lit(False))
    out = F.when(late, "timed out").when(failure.isNotNull(), failure).when(status.isNull(), "no answer")
    out = out.when(~status.between(200, 299), F.concat(F.lit("status "), status.cast("string")))
    return out.when((F.coalesce(kind, F.lit("")) != "") & ~fits, F.concat(F.lit("content type "), kind))


def fetching(fetch: Service, url: str) -> Service:
    def ask(rows: DataFrame) -> DataFrame:
        got = fetch(rows)
        got = got.withColumns({"problem": answer_problem(F.col("status"), F.col("content_type"), F.col("failure")), "final_url": F.coalesce(F.nullif(F.trim("final_url"), F.lit("")), F.col(url))})
        good = F.col("problem").isNull() & ~services.looks_blocked(F.col("body"))
        return got.withColumns({"value": F.when(good, F.col("body")), "note": F.col("problem")})

    return ask


def scraping(scrape: Service) -> Service:
    """What fails or says nothing leaves the row to the next one."""
    return lambda rows: scrape(rows).withColumns({"value": F.when(F.col("failure").isNull(), F.col("body"))})


def fetched(requests: DataFrame, fetch: Callable[[bool], Service], scrapers: dict[str, Service], url: str = "url") -> DataFrame:
    """``requests`` (url) with value, provider, attempted, notes, problem and final_url:
    a page as it came; one that broke in decompression asked for once more, plain;
    one that failed, is a wall or has no text from the first scraper that has some."""
    asked_again = broken_compression(F.col("failure"))
    steps = [Step("compressed", fetching(fetch(False), url)), Step("identity", fetching(fetch(True), url), asked_again)]
    cleared = lambda s: lambda rows: s(rows.withColumns({"failure": F.lit(None).cast("string"), "body": F.lit(None).cast("string")}))
    steps += [Step(name, scraping(cleared(s))) for name, s in scrapers.items()]
    out = resolve(requests, steps, FACTS)
    return out.drop("status", "content_type", "failure", "body", "settled")
