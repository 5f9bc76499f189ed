"""Packing documents into sequences of one length: concatenate and cut.

Two passes. The first encodes every document, in ascending order of its id over range partitions, and
stores ids with the place in their partition; the partitions' token totals, summed up to each, then give every
document its place in the one stream of all tokens. The second cuts the stream at multiples of the
length. What a partition holds of its first and last window are boundary records: they meet the
other partitions' parts by window. Only the last sequence of all can be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm.common import columns, pieces, shared_path, stored
from tilespark.llm.tokens import encoder, tokenizer_path

LENGTH = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
WINDOW = "sequence_id long, at int, ids binary, pieces array<struct<doc_id:long,start:long,length:int,offset:int,doc_tokens:long>>"


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """First pass, stored: ``part, place, doc_id, n, width, ids``; ``ids`` are little-endian of ``width`` bytes and end with
    ``end_id``, ``place`` counts the ids before them in the partition.

    Null text: empty, so only the end id. Null ids come first; rows with one id follow in the order of a hash of
    their text, and repeated rows are documents each. Other columns are not read. No documents: no rows.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)
    order = ("doc_id", F.xxhash64("text"))
    rows = columns(docs, doc_id=F.col(f"`{doc_id}`").cast("long"), text=text).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(path)
        width = 2 if max(coder.vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, upto = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                flat, cuts = coder.encode(piece.column("text"), end_id, f"<u{width}")
                rows = len(piece)
                ids = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(cuts * width), pa.py_buffer(flat)]).cast(pa.binary())
                made = [pa.array(np.full(rows, part, np.int32)), pa.array(upto + cuts[:-1]), piece.column("doc_id"), pa.array(np.diff(cuts)),
                        pa.array(np.full(rows, width, np.int32)), ids]
                yield pa.RecordBatch.from_arrays(made, ["part", "place", "doc_id", "n", "width", "ids"])
                upto += len(flat)

    return stored(rows.mapInArrow(run, "part int, place long, doc_id long, n long, width int, ids binary"), "encoded", compression="zstd")


def placed(encoded: DataFrame) -> DataFrame:
    """The documents with ``first``, their place in the stream of all tokens, and its length ``total``. One row a partition is
    summed up and sent to all: some bytes for each task of the first pass."""
    totals = encoded.groupBy("part").agg(F.sum("n").alias("_tokens"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("_tokens").over(upto), F.lit(0)).alias("_before"),
                           F.sum("_tokens").over(everything).alias("total"))
    met = encoded.join(F.broadcast(before), F.col("part") == F.col("_part"))
    return met.select("doc_id", "n", "width", "ids", (F.col("_before") + F.col("place")).alias("first"), "total")


def _cuts(first: int, n: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Sequence, place in it, place in the document and length of each piece."""
    at = 0
    while at < n:
        sequence, offset = divmod(first + at, length)
        size = min(length - offset, n - at)
        yield sequence, offset, at, size
        at += size


def padded_length(used: int, length: int) -> int:
    """A short sequence is filled up to ``length``, unless it holds a power of two."""
    return used if used & (used - 1) == 0 else length


def cut_pieces(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Second pass: one row per piece of a document (``PIECE``), without the ids themselves but with their checksum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, n, width, first, total, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "width", "first", "total")),
                                                           batch.column("ids"), strict=True):
                wide = memoryview(np.frombuffer(ids.as_buffer(), f"<u{width}").astype("<u4").tobytes())
                for sequence, offset, at, size in _cuts(first, n, length):
                    used = min(length, total - sequence * length)
                    row = (doc_id, at, size, zlib.crc32(wide[4 * at:4 * (at + size)]), n, sequence, offset, padded_length(used, length))
                    for o, value in zip(out, row, strict=True):
                        o.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names)

    return documents.mapInArrow(run, PIECE)


def write_sequences(documents: DataFrame, folder: str | None = None, length: int = LENGTH) -> DataFrame:
    """Second pass with the ids: ``sequence_id, ids`` (little-endian, 4 bytes each, at most ``length``) and ``pieces``, in ``folder``.

    A task joins what follows on in the stream. Windows it can fill are written at once; the windows at the ends of such a
    run are boundary records, at most ``length`` to a window, put together in the order of their place.
    """
    folder = folder or shared_path(documents.sparkSession, "sequences")
    kind = pa.schema([("sequence_id", pa.int64()), ("at", pa.int32()), ("ids", pa.binary()), ("pieces", pa.list_(pa.struct(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("offset", pa.int32()), ("doc_tokens", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[dict] = []
        following, held, held_at, held_in = None, [], 0, []

        def close(sequence: int) -> None:
            if held:
                ready.append({"sequence_id": sequence, "at": held_at, "ids": b"".join(held), "pieces": list(held_in)})
                held.clear()
                held_in.clear()

        for batch in batches:
            for doc_id, n, width, first, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "width", "first")), batch.column("ids"), strict=True):
                if first != following and following is not None:
                    close((following - 1) // length)
                wide = np.frombuffer(ids.as_buffer(), f"<u{width}").astype("<u4").tobytes()
                for sequence, offset, at, size in _cuts(first, n, length):
                    if not held:
                        held_at = offset
                    held.append(wide[4 * at:4 * (at + size)])
                    held_in.append({"doc_id": doc_id, "start": at, "length": size, "offset": offset, "doc_tokens": n})
                    if offset + size == length:
                        close(sequence)
                following = first + n
                if len(ready) >= 512:
                    yield from pa.Table.from_pylist(ready, kind).to_batches()
                    ready.clear()
        if following is not None:
            close((following - 1) // length)
        yield from pa.Table.from_pylist(ready, kind).to_batches()

    whole = (F.col("at") == 0) & (F.octet_length("ids") == 4 * length)
    windows = documents.mapInArrow(run, WINDOW).withColumn("boundary", ~whole)
    windows.write.partitionBy("boundary").parquet(folder)
    rows = documents.sparkSession.read.schema(WINDOW + ", boundary boolean").parquet(folder)
    parts = rows.filter("boundary").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("at", "ids", "pieces"))).alias("p"))
    joined = parts.select("sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x.ids)), "")).alias("ids"),
                          F.flatten(F.transform("p", lambda x: x.pieces)).alias("pieces"))
    return rows.filter("not boundary").select("sequence_id", "ids", "pieces").unionByName(joined)


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Both passes: the pieces of all documents. No documents: no pieces."""
    return cut_pieces(placed(encode(docs, doc_id=doc_id, text=text, tokenizer=tokenizer, end_id=end_id)), length)
