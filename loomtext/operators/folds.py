"""Folds over the rows of a key in their order, in the memory of one state.

Rows are dealt by key and sorted there, so a task meets each key's rows in order
and keeps only that key's state, however many rows it has. Use it where a value
depends on all rows before it and no aggregation combines; what an aggregation
can do belongs in one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

ROWS, SLICE = 4096, 256


class Fold(Protocol):
    def step(self, *values) -> list[tuple]:
        """Rows that follow from the next row's values."""

    def finish(self) -> list[tuple]:
        """Rows that follow from there being no more."""


def folded(rows: DataFrame, key: str, order: list[str], values: list[str], make: Callable[[], Fold], schema: str) -> DataFrame:
    """(key, ...) of what a new ``make()`` for each key returns for its rows, by
    ``order`` (nulls first). Rows alike in key and order should be alike in
    values, or have them in ``order``, as only ``order`` sorts them. A null key is a key."""
    kind = rows.schema[key].dataType.simpleString()
    struct: StructType = _parse_datatype_string(f"`{key}` {kind}, {schema}")
    skip = 1 + len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, out, own, fold = to_arrow_schema(struct), [], None, None

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(named)], schema=named)
            out.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                columns = [part.column(i).to_pylist() for i in (0, *range(skip, part.num_columns))]
                for k, *more in zip(*columns):
                    if fold is None or k != own:
                        if fold is not None:
                            out += [(own, *r) for r in fold.finish()]
                        own, fold = k, make()
                    out += [(k, *r) for r in fold.step(*more)]
                if len(out) >= ROWS:
                    yield made()
        if fold is not None:
            out += [(own, *r) for r in fold.finish()]
        if out:
            yield made()

    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    return dealt.select(key, *(dealt[c].alias(f"order_{i}") for i, c in enumerate(order)), *(dealt[c].alias(f"value_{i}") for i, c in enumerate(values))).mapInArrow(run, struct)
