import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from loomtext.functions import dom
from loomtext.functions.batches import SLICE_ROWS, row_udf, slices


def test_results_leave_before_a_batch_is_read():
    seen = []
    run = row_udf(lambda: lambda x: seen.append(x) or (None if x is None else len(x)), IntegerType()).func
    out = run(iter([pa.array(["x" * 1000, None] * 5_000), pa.array([], pa.string()), pa.array(["y"])]))
    first = next(out)
    assert len(seen) == len(first) <= SLICE_ROWS
    assert [*first.to_pylist(), *(n for part in out for n in part.to_pylist())] == [1000, None] * 5_000 + [1]
    long = pa.array(["z" * (3 << 20)] * 4)
    assert [len(a) for a, _ in slices((long, pa.array(range(4))))] == [1] * 4


def test_page_udfs_hold_slices_and_keep_rows_in_place(spark):
    assert all(u.evalType == F.arrow_udf(row_udf(lambda: len, IntegerType()).func, "int").evalType for u in (dom._facts(), dom.told_markup_col))
    pages = spark.range(3000, numPartitions=1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("<title>t"), "id", F.lit("</title><style>p</style>"))).alias("html"))
    rows = pages.select("id", "html", dom.facts(F.col("html"), F.lit("https://a.example/")).alias("f"), dom.told_markup_col(F.col("html")).alias("m")).collect()
    assert len(rows) == 3000
    for r in rows:
        assert r.f.title == (f"t{r.id}" if r.html else None) and r.f.html_chars == len(r.html or "")
        assert r.m == (f"<title>t{r.id}</title>" if r.html else None)
