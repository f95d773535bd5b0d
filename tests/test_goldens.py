import pytest
from pyspark.sql import functions as F

from loomtext.functions import payloads
from loomtext.plans.goldens import GOLDENS

from .compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", ["golden_time", "golden_payload", "golden_service"])
def test_large_ids_equal_sql(spark, tmp_path, name):
    """Doubles from ten million on are written in plain decimals."""
    ids = [0, 1, 2777, 2778, 9_999, 100_000, 1_234_567, 9_999_999]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).write.parquet(f"{tmp_path}/t")
    part = next(tmp_path.glob("t/*.parquet"))
    part.rename(tmp_path / "documents.parquet")
    query, sql = GOLDENS[name]
    assert spark_rows(query(spark, str(tmp_path))) == duck_rows(sql, str(tmp_path))


@pytest.mark.parametrize("name", ["json_transcript_text", "json_segments", "message_author"])
def test_a_payload_is_parsed_once(spark, name):
    plan = spark.createDataFrame([("{}",)], "raw string").select(getattr(payloads, name)(F.col("raw")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json(") == 1
