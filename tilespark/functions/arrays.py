"""Array columns as numpy arrays, a bounded batch of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from tilespark.session import ship_package


def lists(column: pa.ListArray) -> Iterator[pa.Array | None]:
    """The elements of each row of a list column."""
    offsets, values, missing = column.offsets.to_pylist(), column.values, column.is_null().to_pylist()
    for a, b, none in zip(offsets[:-1], offsets[1:], missing, strict=True):
        yield None if none else values.slice(a, b - a)


def arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Each row's numbers; a missing number is NaN."""
    for part in lists(column):
        yield np.empty(0) if part is None else part.to_numpy(zero_copy_only=False).astype(np.float64)


def rasters(rows: Sequence[np.ndarray]) -> pa.ListArray:
    """A list column of numbers; NaN is missing."""
    flat = np.concatenate(rows) if len(rows) else np.empty(0)
    offsets = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.float64(), mask=np.isnan(flat)))


def by_batch(
    df: DataFrame, work: Callable[[pa.RecordBatch], tuple[np.ndarray, dict]], keep: Sequence[StructField], made: str
) -> DataFrame:
    """The columns ``keep`` of ``df`` and those that ``work`` makes of each batch.

    ``work`` returns the row of the batch that each result row belongs to, and the new columns. Batches
    are bounded in bytes by the session's settings.
    """
    ship_package(df.sparkSession)
    added = StructType.fromDDL(made)
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, new = work(batch)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(n).take(rows) for n in names] + [new[f.name] for f in added.fields],
                                             names + [f.name for f in added.fields])

    return df.mapInArrow(run, StructType([*keep, *added.fields]))
