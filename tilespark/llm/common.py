"""Helpers the operators share: inputs, stored intermediate tables, Arrow batches, word tables."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.session import checkpoint_dir, ship_package, tune

#: Rows go to Python workers in batches of about this size, so that several workers fit beside an executor's heap.
BATCH_BYTES = 16 << 20
#: Characters between words of the contracts: space, tab, line feed, vertical tab, form feed, return.
BLANK = "[\\x20\\x09-\\x0D]+"

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None  # glibc only


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> SparkSession:
    """Session settings, and the package on the workers."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, free: bool = False, compression: str = "snappy") -> DataFrame:
    """Write ``df`` in the shared folder and read it back: later steps survive lost executors and
    don't compute it again. The folder's owner removes it. ``free`` lets Spark delete at once the shuffle
    files that only steps up to here needed, which it does when it finds their plans unused."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if free:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` gave, once all that was derived from them is stored itself."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(conf).delete(path, True)


def columns(df: DataFrame, **named: str | Column) -> DataFrame:
    """Only the named columns, under names of our own, so that other columns can't clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in named.items()])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it if the frame has it (in any case) already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Lazy(dict):
    """A dictionary that computes what it lacks; emptied once it holds ``most`` entries."""

    def __init__(self, make: Callable, most: int = 150_000):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def release() -> None:
    """Give back what Arrow and the C library keep of a batch's memory, as a worker that waits would keep it beside those that run."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text, a row at least."""
    kind = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(kind), 0), dtype=np.int64)
    part = np.cumsum(sizes) // limit
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
        yield batch.slice(int(a), int(b - a))


def flat_words(column: pa.Array, lower: bool = True) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts, one after the other, and where each text begins (one more than texts).

    A word is a run of bytes other than ASCII white space; lower-casing touches A-Z only.
    """
    words: list[bytes] = []
    ends = [0]
    for t in texts(column):
        words += (t.lower() if lower else t).split()
        ends.append(len(words))
    return words, np.asarray(ends, dtype=np.int64)


def add_by_batch(df: DataFrame, schema: str, fill: Callable[[pa.RecordBatch], dict], text: str) -> DataFrame:
    """All columns of ``df`` and those of ``schema``, which ``fill`` makes from a slice of an Arrow batch.

    Slices hold about 4 MB of the column ``text``. Names in ``schema`` must not be columns of ``df``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)
    kinds = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                made = fill(piece)
                arrays = [*piece.columns, *(pa.array(made[f.name], f.type) for f in kinds)]
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([*piece.schema, *kinds]))
            release()

    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))
