"""Token ids in a binary table: fixed-size blocks, cut into byte planes, each plane compressed with zstandard.

A table is a Parquet dataset, so that it can be written to and read from any store that Spark knows, under Spark's
commit protocol: a task that is lost or runs twice leaves nothing behind. Its rows are segments of whole documents:

    part, segment      order of the segments; documents ascend by id through them (null ids first)
    before             ids of the part's segments before this one
    width, block       bytes of an id; ids of a block (the last of a segment may have fewer)
    doc_ids, lengths   the documents of the segment and their numbers of ids
    offsets            the chunk index: for each block and plane the end of its bytes in planes
    planes             plane 0 of block 0 (the lowest bytes of its ids), plane 1 of block 0, ..., each a zstandard frame

A segment closes at SEGMENT ids, so memory is bounded by that or by the longest document. The ids before a document
are those before its segment in the part, which the segment holds, and those of the parts before, whose totals are
broadcast: a row for each write task, which the driver has scheduled one by one before.

Null texts are encoded as empty ones, and have the end id. Repeated rows and null ids are kept, one for each row; rows
with equal ids stand in order of their text. Other columns, of whatever name, are left out. An empty table has no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm import tokens
from docmill.llm.common import in_arrow, slices

BLOCK, SEGMENT, LEVEL = 1 << 16, 1 << 20, 3
FIELDS = "part int, segment int, before bigint, width int, block int, doc_ids array<bigint>, lengths array<bigint>, offsets array<bigint>, planes binary"


def pack(ids: np.ndarray, block: int = BLOCK, level: int = LEVEL) -> tuple[bytes, list[int]]:
    """Planes and chunk index of ids; their dtype's width is the number of planes."""
    import zstandard

    compress, width = zstandard.ZstdCompressor(level=level).compress, ids.dtype.itemsize
    frames, ends, at = [], [], 0
    for i in range(0, len(ids), block):
        planes = np.ascontiguousarray(ids[i : i + block].view(np.uint8).reshape(-1, width).T)
        for plane in planes:
            frames.append(compress(plane.tobytes()))
            ends.append(at := at + len(frames[-1]))
    return b"".join(frames), ends


def unpack(planes: bytes, ends: list[int], width: int) -> np.ndarray:
    """All ids of a segment."""
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    starts, blocks = [0, *ends], []
    for i in range(0, len(ends), width):
        rows = [np.frombuffer(decompress(planes[starts[j] : starts[j + 1]]), np.uint8) for j in range(i, i + width)]
        blocks.append(np.ascontiguousarray(np.stack(rows, axis=1)).reshape(-1).view(f"<u{width}"))
    return np.concatenate(blocks) if blocks else np.empty(0, f"<u{width}")


def write_token_planes(documents: DataFrame, target: str, tokenizer: str, *, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends end_id, and writes a token table to target."""
    width = tokens.width_of(tokenizer)
    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # the text only parts rows with one id, so that repeated ids can't fill a task
    ordered = texts.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece, part = tokens.pieces(tokenizer, width), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.asarray([end_id], piece.kind).tobytes()
        doc_ids, rows, lengths, held, segment, before = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            planes, ends = pack(np.frombuffer(b"".join(rows), piece.kind))
            values = [[part], [segment], [before], [width], [BLOCK], [doc_ids], [lengths], [ends], [planes]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()] + [pa.list_(pa.int64())] * 3 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["part", "segment", "before", "width", "block", "doc_ids", "lengths", "offsets", "planes"])

        for batch in slices(batches):
            for i, ids in zip(batch.column("id").to_pylist(), piece.encode_all(batch.column("text").to_pylist()), strict=True):
                doc_ids.append(i), rows.append(ids + end), lengths.append(len(rows[-1]) // width)
                held += lengths[-1]
                if held >= SEGMENT:
                    yield close()
                    doc_ids, rows, lengths, held, segment, before = [], [], [], 0, segment + 1, before + held
        if doc_ids:
            yield close()

    in_arrow(ordered, encode, FIELDS, "tokens").write.option("compression", "none").parquet(target)


def read_token_planes(spark: SparkSession, target: str, *, id_col: str = "doc_id") -> DataFrame:
    """Per document: id_col, start (ids of all documents before it), n_tokens, ids (binary, little-endian of width bytes), width."""
    table = spark.read.schema(FIELDS).parquet(target)
    parts = table.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("p"), earlier.alias("earlier"))  # a row for each write task

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            ids = unpack(row["planes"], row["offsets"], row["width"])
            ends = np.cumsum(np.asarray(row["lengths"], np.int64))
            firsts = ends - np.asarray(row["lengths"], np.int64)
            data = [ids[i:j].tobytes() for i, j in zip(firsts.tolist(), ends.tolist(), strict=True)]
            n = len(data)
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(firsts + row["before"]), pa.array(row["lengths"], pa.int64()), pa.array(data, pa.binary()), pa.array([row["width"]] * n, pa.int32())], names=["part", "id", "first", "n_tokens", "ids", "width"])

    docs = in_arrow(table, decode, "part int, id bigint, first bigint, n_tokens bigint, ids binary, width int", "tokens").join(F.broadcast(parts), F.col("part") == F.col("p"))
    return docs.select(F.col("id").alias(id_col), (F.col("first") + F.col("earlier")).alias("start"), "n_tokens", "ids", "width")


def with_crc32(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id", "start", "n_tokens")) -> DataFrame:
    """keep and ids_crc32, of the ids as little-endian unsigned 32-bit integers."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()) for ids, width in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.int64())], names=[*keep, "ids_crc32"])

    return in_arrow(docs.select(*keep, "ids", "width"), crc, f"{schema}, ids_crc32 bigint", "tokens")
