"""Arrow-batched row mapping with bounded slices, shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

SLICE_ROWS = 1024
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of at most SLICE_ROWS rows and, for more than
    one row, about SLICE_BYTES bytes, so that no working set follows the batch."""
    n = batch.num_rows
    if n == 0:
        return
    rows = max(1, min(SLICE_ROWS, int(SLICE_BYTES / max(1.0, batch.nbytes / n))))
    for at in range(0, n, rows):
        yield batch.slice(at, rows)


def map_slices(df: DataFrame, make: Callable[[], Callable[..., dict]], schema: str | StructType) -> DataFrame:
    """``df`` through ``make()``'s function, in Arrow slices.

    ``make`` runs once in each task; what it returns takes the columns of a
    slice as Python lists, in order, and returns a dict of output columns.
    """
    struct = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, out = make(), to_arrow_schema(struct)
        for batch in batches:
            for part in slices(batch):
                cols = fn(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, struct)
