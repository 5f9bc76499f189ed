"""Token-id files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A shard file is a run of zstandard frames and, last, a skippable frame with the seek table of the
public seekable format: compressed size, content size and checksum of each frame. A frame holds
some whole documents: their number, whether each has an id, the ids, their lengths, and then the
token ids, little-endian, 2 bytes each where the vocabulary allows it and 4 otherwise. Any frame
can be read by itself; a frame whose checksum differs is refused.

Documents lie in ascending order of their id over all shards (null first; repeated ids in the order
of a hash of their text). ``write_tokens`` returns the catalogue, one row per frame; a task that
runs again writes the same file under the same name, and only whole files get that name.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm.common import columns, pieces, shared_path
from tilespark.llm.tokens import encoder, tokenizer_path

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC, SEEK_MAGIC, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_BYTES = 256 << 10

CATALOGUE = ("shard string, part int, frame int, position long, packed long, n_tokens long, "
             "doc_ids array<long>, lengths array<long>")
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _place(path: str):
    """File system and path on it of a path or URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _sum32(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def pack(doc_ids: list[int | None], lengths: np.ndarray, tokens: list[bytes], width: int) -> bytes:
    """Content of a frame: ``tokens`` are the little-endian ids of all its documents, in any number of parts."""
    known = bytes(d is not None for d in doc_ids)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    return b"".join([struct.pack("<IB", len(doc_ids), width), known, ids, lengths.astype("<u4").tobytes(), *tokens])


def unpack(content: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    n, width = struct.unpack_from("<IB", content)
    known, at = content[5:5 + n], 5 + n
    ids = np.frombuffer(content, "<i8", n, at)
    lengths = np.frombuffer(content, "<u4", n, at + 8 * n).astype(np.int64)
    tokens = np.frombuffer(content, f"<u{width}", offset=at + 12 * n).astype("<u4")
    cuts = np.r_[0, np.cumsum(lengths)].tolist()
    return [d if k else None for d, k in zip(ids.tolist(), known, strict=True)], [tokens[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class ShardWriter:
    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.press, self.table, self.at = out, zstandard.ZstdCompressor(level=level), [], 0

    def frame(self, content: bytes) -> tuple[int, int]:
        packed = self.press.compress(content)
        self.out.write(packed)
        self.table.append(struct.pack("<III", len(packed), len(content), _sum32(content)))
        self.at += len(packed)
        return self.at - len(packed), len(packed)

    def finish(self) -> None:
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class ShardReader:
    """Reads single frames of a shard by its seek table."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, io.SEEK_END)
        if end < 17:
            raise ValueError("no seek table")
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flags != WITH_CHECKSUMS or end < 17 + 12 * n:
            raise ValueError("no seek table")
        source.seek(end - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.position = np.r_[0, np.cumsum(self.table[:, 0])]

    def __len__(self) -> int:
        return len(self.table)

    def content(self, frame: int) -> bytes:
        import zstandard

        packed, size, check = self.table[frame]
        self.source.seek(int(self.position[frame]))
        got = zstandard.ZstdDecompressor().decompress(self.source.read(int(packed)), max_output_size=int(size))
        if len(got) != size or _sum32(got) != check:
            raise ValueError(f"frame {frame} is damaged")
        return got


def write_tokens(docs: DataFrame, folder: str | None = None, *, doc_id: str = "doc_id", text: str = "text",
                 tokenizer: str | None = None, end_id: int = 1, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode every whole text and write the shard files; returns the stored catalogue.

    Null text: empty, so only the end id. An empty table: no shard, an empty catalogue. A text
    longer than a frame gets a frame of its own. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    tokenizer = tokenizer or tokenizer_path()
    rows = (columns(docs, doc_id=F.col(f"`{doc_id}`").cast("long"), text=text)
            .repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text")))

    schema = pa.schema([("shard", pa.string()), ("part", pa.int32()), ("frame", pa.int32()), ("position", pa.int64()), ("packed", pa.int64()),
                        ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(tokenizer)
        width = 2 if max(coder.vocab_size(), end_id + 1) <= 1 << 16 else 4
        part = TaskContext.get().partitionId()
        system, base = _place(folder)
        name, made = f"{base}/part-{part:07d}.tokens", []
        held, room, trial, writer, out = ([], [], []), frame_bytes // width, "", None, None

        def flush() -> None:
            lengths = np.concatenate(held[1])
            position, packed = writer.frame(pack(held[0], lengths, held[2], width))
            made.append((len(made), position, packed, int(lengths.sum()), list(held[0]), lengths))
            for h in held:
                h.clear()

        for batch in batches:
            for piece in pieces(batch, "text"):
                if writer is None:
                    system.create_dir(base, recursive=True)
                    trial = f"{base}/.{part}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(trial)
                    writer = ShardWriter(out)
                doc_ids = piece.column("doc_id").to_pylist()
                flat, cuts = coder.encode(piece.column("text"), end_id, f"<u{width}")
                i = 0
                while i < len(doc_ids):  # as many documents as the frame has room for
                    j = int(np.searchsorted(cuts, cuts[i] + room, side="right")) - 1
                    if j <= i:
                        if held[0]:
                            flush()
                            room = frame_bytes // width
                            continue
                        j = i + 1
                    for h, x in zip(held, (doc_ids[i:j], [np.diff(cuts[i:j + 1])], [flat[cuts[i]:cuts[j]].tobytes()]), strict=True):
                        h.extend(x)
                    room -= int(cuts[j] - cuts[i])
                    i = j
        if writer is not None:
            flush()
            writer.finish()
            out.close()
            system.move(trial, name)
        for i in range(0, len(made), 64):
            frame, position, packed, n_tokens, ids, lengths = zip(*made[i:i + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                ([f"{folder}/part-{part:07d}.tokens"] * len(frame), [part] * len(frame), frame, position, packed, n_tokens, ids, lengths),
                schema.types, strict=True)], schema=schema)

    catalogue = f"{folder}/catalogue"
    rows.mapInArrow(write, CATALOGUE).write.parquet(catalogue)
    return spark.read.schema(CATALOGUE).parquet(catalogue)


def frame_starts(catalogue: DataFrame) -> DataFrame:
    """The catalogue with ``start``: ids of all frames before. Totals of shards are carried first, so
    that no window holds more than one shard's frames or one row per shard."""
    shards = catalogue.groupBy("part").agg(F.sum("n_tokens").alias("_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("part", F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    return (catalogue.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(shards, "part")
            .withColumn("start", F.col("start") + F.col("_before")).drop("_before"))


def _spread(frames: DataFrame) -> DataFrame:
    """Frames dealt out evenly, about 32 MB of them to a task, those of a shard one after the other."""
    total = frames.agg(F.sum("packed")).head()[0] or 0
    tasks = max(frames.sparkSession.sparkContext.defaultParallelism * 2, int(total >> 25))
    return frames.repartitionByRange(tasks, "part", "frame").sortWithinPartitions("part", "frame")


def _read(frames: DataFrame, schema: str, rows_of) -> DataFrame:
    kind = pa.schema(rows_of(None, None, None, None))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, file, reader = None, None, None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["shard"] != shard:  # the seek table is read once
                        if file is not None:
                            file.close()
                        shard = row["shard"]
                        system, path = _place(shard)
                        file = system.open_input_file(path)
                        reader = ShardReader(file)
                    ids, tokens = unpack(reader.content(row["frame"]))
                    yield from pa.Table.from_pydict(rows_of(row, ids, tokens, kind), schema=kind).to_batches()
        finally:
            if file is not None:
                file.close()

    return frames.mapInArrow(read, schema)


def read_digests(catalogue: DataFrame) -> DataFrame:
    """Every document as the files hold it: id, ids before it, number of ids, their checksum."""
    def rows(row, ids, tokens, kind):
        if row is None:
            return [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        n = [len(t) for t in tokens]
        return {"doc_id": ids, "start": (row["start"] + np.r_[0, np.cumsum(n)][:-1]).tolist(), "n_tokens": n,
                "ids_crc32": list(map(zlib.crc32, tokens))}

    frames = frame_starts(catalogue.drop("doc_ids", "lengths"))
    return _read(_spread(frames).select("shard", "frame", "start"), DOCUMENTS, rows)


def read_documents(catalogue: DataFrame, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Token ids of the wanted documents; only frames that hold one are read and decompressed."""
    ids = columns(wanted, doc_id=F.col(f"`{doc_id}`").cast("long")).distinct()
    index = catalogue.select("shard", "part", "frame", "packed", F.explode("doc_ids").alias("doc_id"))
    hits = index.join(ids, index["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    frames = hits.groupBy("shard", "part", "frame", "packed").agg(F.collect_set("doc_id").alias("ids"), F.max(F.isnull("doc_id")).alias("nulls"))

    def rows(row, got, tokens, kind):
        if row is None:
            return [("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]
        keep = set(row["ids"])
        use = [i for i, d in enumerate(got) if d in keep or d is None and row["nulls"]]
        return {"doc_id": [got[i] for i in use], "ids": [tokens[i].tolist() for i in use]}

    return _read(_spread(frames).select("shard", "frame", "ids", "nulls"), "doc_id long, ids array<long>", rows)
