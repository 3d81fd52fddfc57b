"""BPE encoding with reuse of content-defined chunks, and decoding.

A gear hash of the last 16 bytes cuts a text where its low bits are 0, so equal passages are cut alike wherever they
stand. Of a chunk, the core is what lies between its first and its last certain cut: a blank behind a visible ASCII
character, where a byte-level tokenizer ends a pre-token whatever stands around. A core's ids are the same in every
text; what lies between two cores is a join.

1. One pass cuts every text and writes the hashes of the text and of its cores. Cores that occur twice or more set a
   bit in a filter, and so do the hashes of texts that have one. The filters have 16 bits for each hash, up to a bound
   beyond which they let more than one of 400 through; what they let through is held together by exact hashes.
2. Texts in the second filter are reduced to distinct ones and written. All others are encoded where they are read.
3. Of these, each core that several texts share is encoded once, in the text with the smallest key that holds it, and
   its ids are joined to every place.
4. Joins are repaired: the text from the end of one core to the start of the next that has ids is encoded as one. Both
   ends are certain cuts, so the ids agree exactly with those of the whole text; where a chunk has no core, the
   repaired span grows over it.

Null texts are encoded as empty ones, long ones whole. One row comes back for each row of documents, repeated rows, null
ids and all; other columns, of whatever name, are left out, and an empty table has no rows.
Tokenizers other than byte-level ones without prefix blank are refused, as nothing is known of their cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import tokens
from docmill.llm.common import bit_filter, in_arrow, in_filter, slices, written

CUT_BITS, LEAST_CORE = 10, 64
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)


def cores(raw: bytes) -> list[tuple[int, int]]:
    """Start and end of the core of each chunk that has one of LEAST_CORE bytes or more."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) < LEAST_CORE:
        return []
    h = _GEAR[b]
    for by in (1, 2, 4, 8):  # the last 16 bytes, each shifted once more than the next
        h[by:] = h[by:] + (h[:-by] << np.uint32(by))
    ends = np.flatnonzero((h >> np.uint32(16)) & np.uint32((1 << CUT_BITS) - 1) == 0) + 1
    sure = np.flatnonzero((b[1:] == 32) & (b[:-1] > 32) & (b[:-1] < 127)) + 1
    if len(sure) < 2:
        return []
    edges = np.unique(np.concatenate([[0], ends, [len(b)]]))
    first = np.searchsorted(sure, edges[:-1])
    last = np.searchsorted(sure, edges[1:], side="right") - 1
    good = first < last
    starts, stops = sure[first[good]], sure[last[good]]
    return [(s, e) for s, e in zip(starts.tolist(), stops.tolist(), strict=True) if e - s >= LEAST_CORE]


def _hash(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _short(h: bytes) -> int:
    return int.from_bytes(h[:8], "little", signed=True)


def _joined(raw: bytes, spans: list[tuple[int, int]], have: dict[bytes, bytes], encode) -> bytes:
    """ids of the text: cores whose ids are known, and what lies between them encoded as one."""
    out, at = [], 0
    for s, e in spans:
        known = have.get(_hash(raw[s:e]))
        if known is not None:
            if s > at:
                out.append(encode(raw[at:s].decode()))
            out.append(known)
            at = e
    if at < len(raw):
        out.append(encode(raw[at:].decode()))
    return b"".join(out)


def _encoders(documents: DataFrame, path: str, id_col: str, text_col: str):
    """Rows to read (id, raw), what encodes those of them that aren't aside, the type of id, and id, ids of the others."""
    if tokens.Pieces(path).blank != " ":
        raise ValueError("chunks are reused with byte-level tokenizers only")
    width = tokens.width_of(path)
    kind = documents.schema[id_col].dataType.simpleString()
    texts = documents.select(F.col(id_col).alias("id"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("raw"))
    send = documents.sparkSession.sparkContext.broadcast

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = batch.column("raw").to_pylist()
            found = [[_short(_hash(raw[s:e])) for s, e in cores(raw)] for raw in raws]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(_hash, raws), pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["id", "key", "cores"])

    chunks = written(in_arrow(texts, cut, f"id {kind}, key binary, cores array<bigint>", "tokens"), "chunks")
    repeated = chunks.select(F.explode("cores").alias("h")).groupBy("h").count().filter("count > 1").select("h")
    shared = send(bit_filter(written(repeated, "repeated")))

    def with_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([bool(len(x)) and bool(in_filter(x, shared.value).any()) for x in batch.column("cores").to_pylist()], pa.bool_())).select(["key"])

    sharing = in_arrow(chunks.select("key", "cores"), with_shared, "key binary", "tokens").distinct()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_short(k) for k in batch.column("key").to_pylist()], pa.int64())], names=["h"])

    aside = send(bit_filter(written(in_arrow(sharing, short, "h bigint", "tokens"), "sharing")))

    def is_aside(keys: list[bytes]) -> np.ndarray:
        return in_filter([_short(k) for k in keys], aside.value) if keys else np.empty(0, bool)

    def set_aside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [_hash(raw) for raw in batch.column("raw").to_pylist()]
            keep = is_aside(keys)
            raws = batch.column("raw").filter(pa.array(keep))
            found = [[_hash(raw[s:e]) for s, e in cores(raw)] for raw in raws.to_pylist()]
            yield pa.RecordBatch.from_arrays([raws, pa.array([k for k, x in zip(keys, keep, strict=True) if x], pa.binary()), pa.array(found, pa.list_(pa.binary()))], names=["raw", "key", "cores"])

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(is_aside(batch.column("key").to_pylist())))

    def encode_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.pieces(path, width).encode
        for batch in slices(batches):
            batch = batch.filter(pa.array(~is_aside([_hash(raw) for raw in batch.column("raw").to_pylist()])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([encode(raw.decode()) for raw in batch.column("raw").to_pylist()], pa.binary())], names=["id", "ids"])

    def encode_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.pieces(path, width).encode
        for batch in slices(batches):
            core, ids = [], []
            for raw, own in zip(batch.column("raw").to_pylist(), batch.column("own").to_pylist(), strict=True):
                own = set(own)
                for s, e in cores(raw):
                    if (h := _hash(raw[s:e])) in own:
                        own.discard(h)
                        core.append(h), ids.append(encode(raw[s:e].decode()))
            yield pa.RecordBatch.from_arrays([pa.array(core, pa.binary()), pa.array(ids, pa.binary())], names=["core", "ids"])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.pieces(path, width).encode
        for batch in slices(batches):
            out = []
            for raw, have in zip(batch.column("raw").to_pylist(), batch.column("have").to_pylist(), strict=True):
                out.append(_joined(raw, cores(raw), {x["core"]: x["ids"] for x in have or []}, encode))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], names=["key", "ids"])

    found = in_arrow(texts.select("raw"), set_aside, "raw binary, key binary, cores array<binary>", "tokens")
    distinct = written(found.groupBy("key").agg(F.first("raw").alias("raw"), F.first("cores").alias("cores")), "texts")
    places = distinct.select("key", F.explode("cores").alias("core"))
    owners = places.groupBy("core").agg(F.min("key").alias("key"), F.count("*").alias("n")).filter("n > 1")
    own = owners.groupBy("key").agg(F.collect_list("core").alias("own"))
    encoded = written(in_arrow(distinct.select("key", "raw").join(own, "key").select("raw", "own"), encode_own, "core binary, ids binary", "tokens"), "cores")
    have = places.distinct().join(encoded, "core").groupBy("key").agg(F.collect_list(F.struct("core", "ids")).alias("have"))
    repaired = in_arrow(distinct.select("key", "raw").join(have, "key", "left").select("key", "raw", "have"), repair, "key binary, ids binary", "tokens")
    back = in_arrow(chunks.select("id", "key"), places_of, f"id {kind}, key binary", "tokens")
    return texts, encode_rest, kind, back.join(repaired.hint("merge"), "key").select("id", "ids")  # by shuffle: a broadcast would have two workers in a task


def encode_documents(documents: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (binary: unsigned 16-bit little-endian ids, 32-bit for vocabularies beyond that), one row for each row."""
    texts, encode_rest, kind, back = _encoders(documents, path, id_col, text_col)
    return in_arrow(texts, encode_rest, f"id {kind}, ids binary", "tokens").unionByName(back).withColumnRenamed("id", id_col)


def encode_and_decode(documents: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode_ids() of encode_documents(), keeping id_col; a text that is encoded where it is read is decoded by the same
    worker, so that no task has two of them, each with a tokenizer."""
    texts, encode_rest, kind, back = _encoders(documents, path, id_col, text_col)
    decode = _decoder(path, ["id"], "ids")
    own = in_arrow(texts, lambda batches: decode(encode_rest(batches)), f"id {kind}, ids binary, {DECODED}", "tokens")
    return own.unionByName(decode_ids(back, path, keep=("id",))).withColumnRenamed("id", id_col)


DECODED = "n_tokens bigint, ids_sha256 string, text string"


def _decoder(path: str, keep: list[str], ids_col: str):
    """Of batches with the columns keep and ids_col, those and DECODED."""
    names, width = [*keep, ids_col], tokens.width_of(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokens.pieces(path, width).bytes_of
        decimal = [str(i) for i in range(len(of))]
        for batch in slices(batches):
            n, sha, texts = [], [], []
            for raw in batch.column(ids_col).to_pylist():
                ids = np.frombuffer(raw or b"", f"<u{width}").tolist()
                n.append(len(ids))
                sha.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                texts.append(b"".join([of[i] for i in ids]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], names=[*names, "n_tokens", "ids_sha256", "text"])

    return decode


def decode_ids(encoded: DataFrame, path: str, *, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """keep, ids_col, n_tokens, ids_sha256 (of the decimal ids, joined by commas), text (as the library's decode, special tokens included)."""
    names = [*keep, ids_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*names).schema)
    return in_arrow(encoded.select(*names), _decoder(path, list(keep), ids_col), f"{schema}, {DECODED}", "tokens")
