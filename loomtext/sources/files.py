"""Files and injected services.

Network, models, transcription and conversion stay outside: a service is a
function from a batch of requests to a batch of answers that ``answered`` applies
in Arrow batches. None is shipped; tests inject deterministic ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from loomtext.functions import urls

MOST_BYTES = 50 << 20


def load_files(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, name, bytes, media_type, text, problem): text where it is UTF-8 text; a
    file over the size limit is not read and has the problem ``too large``."""
    found = spark.read.format("binaryFile").load(path)
    rows = found.where(F.col("length") <= most)
    name = F.regexp_extract("path", r"[^/]*\z", 0)
    kind = urls.mime_of(F.col("content"), F.lit(None).cast("string"), name)
    readable = F.is_valid_utf8(F.col("content").cast("string"))
    rows = rows.select("path", name.alias("name"), F.col("content").alias("bytes"), kind.alias("media_type"), F.when(urls.is_text_type(kind) & readable, F.col("content").cast("string")).alias("text"), F.lit(None).cast("string").alias("problem"))
    return rows.union(found.where(F.col("length") > most).select("path", name, F.lit(None), F.lit(None), F.lit(None), F.lit("too large")))


def spooled(rows: DataFrame, column: str = "bytes", most: int = MOST_BYTES) -> DataFrame:
    """Binary input with ``problem``: too large, not text, blank, or null if fine."""
    text = F.col(column).cast("string")
    bad = F.when(F.length(column) > most, "too large").when(~F.is_valid_utf8(text) | F.contains(text, F.lit("\0")), "not text").when(F.trim(text) == "", "blank")
    return rows.withColumn("problem", bad)


def answered(requests: DataFrame, service: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """``requests`` through a service, batch by batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield service(batch)

    return requests.mapInPandas(run, schema)


def log_tail(spark: SparkSession, path: str, lines: int, most_bytes: int = 1 << 20) -> DataFrame:
    """(n, line): the last whole lines of a file's last bytes."""
    rows = spark.read.format("binaryFile").load(path).select(F.col("length").alias("size"), F.col("content").substr(F.greatest(F.col("length") - most_bytes + 1, F.lit(1)).cast("int"), F.lit(most_bytes)).cast("string").alias("text"))
    kept = F.when(F.col("size") > most_bytes, F.regexp_replace("text", r"^[^\n]*\n", "")).otherwise(F.col("text"))
    own = F.split(F.regexp_replace(kept, r"\n\z", ""), "\n")
    return rows.select(F.posexplode(F.slice(own, F.greatest(F.size(own) - lines + 1, F.lit(1)), F.lit(lines))).alias("n", "line"))


def write_report(rows: DataFrame, path: str) -> None:
    """One JSON document for each row, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def valid_slides(records: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Slide records that were made with exactly the parameters wanted and have their files."""
    same = [records[k].eqNullSafe(wanted[k]) for k in keys]
    return records.join(wanted, same, "left_semi").where(F.forall("slides", lambda s: F.coalesce(s["path"] != "", F.lit(False))))
