"""Arrow UDFs of functions of one row, whose working set does not follow Spark's batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

#: What is held as Python objects at a time, beside one row of any size.
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20


def slices(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    n, size = len(columns[0]), sum(c.nbytes for c in columns)
    rows = max(1, min(SLICE_ROWS, int(SLICE_BYTES * n / max(1, size))))
    for at in range(0, n, rows):
        yield tuple(c.slice(at, rows) for c in columns)


def row_udf(make: Callable[[], Callable], kind: str | DataType) -> Callable:
    """``make()``'s function over rows, as a UDF; ``make`` runs once in each task. Results
    leave for Spark slice by slice, so neither they nor the rows are held for a whole batch."""
    kind = _parse_datatype_string(kind) if isinstance(kind, str) else kind

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        fn, arrow = make(), to_arrow_type(kind)
        for batch in batches:
            for part in slices(batch if isinstance(batch, tuple) else (batch,)):
                yield pa.array((fn(*row) for row in zip(*(c.to_pylist() for c in part))), arrow)

    return F.arrow_udf(run, kind)
