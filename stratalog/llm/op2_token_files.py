"""Token ids in patched frame-of-reference files.

A table of segments in Parquet holds the ids: each row is one segment, a self-contained binary image, so that Spark's committers make the
writing atomic and any store that Spark reaches can hold it. A segment's ids stand in blocks of ``BLOCK`` values. A block subtracts its
minimum, packs what is left at the width that ``WIDE`` of its values fit, and lists the rest as exceptions; an index gives each block's start
in the segment, so a block is read without those before it. Documents' lengths are stored the same way.

Nulls and empty texts count as empty: they have the end id alone. Repeated rows of a doc_id each keep their own ids, in arbitrary order
among themselves. Rows without a doc_id come first. An empty table gives an empty file. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table
from .tokens import encoder, vocabulary_path

BLOCK = 128
#: The share of a block's values that its width must hold.
WIDE = 0.9
#: A segment is closed after the document with which it reaches so many ids.
SEGMENT_IDS = 1 << 18
_MAGIC = b"PFR1"


def _widths(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as blocks: count, block starts, then per block minimum, width, exceptions and packed rests."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return struct.pack("<QQ", 0, 0)
    padded = np.concatenate([values, np.full(blocks * BLOCK - n, values[-1], values.dtype)]).reshape(blocks, BLOCK).astype(np.uint32)
    least = padded.min(axis=1)
    rest = padded - least[:, None]
    at = int(np.ceil(WIDE * BLOCK)) - 1
    width = _widths(np.partition(rest, at, axis=1)[:, at])
    over = rest >> np.minimum(width, 31)[:, None].astype(np.uint32) != 0
    over[width >= 32] = False
    odd = over.sum(axis=1).astype(np.uint8)
    low = rest & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    size = 6 + 5 * odd.astype(np.int64) + BLOCK // 8 * width.astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(start[-1], np.uint8)
    head = np.zeros((blocks, 6), np.uint8)
    head[:, :4], head[:, 4], head[:, 5] = least.astype("<u4").view(np.uint8).reshape(blocks, 4), width, odd
    out[start[:-1, None] + np.arange(6)] = head
    row, place = np.nonzero(over)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(odd.astype(np.int64)) - odd, odd)
        to = start[row] + 6 + 5 * nth
        out[to] = place
        out[to[:, None] + 1 + np.arange(4)] = rest[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    for w in np.unique(width[width > 0]):
        at = np.nonzero(width == w)[0]
        bits = np.unpackbits(low[at].astype("<u4").view(np.uint8).reshape(len(at), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        body = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
        out[(start[at] + 6 + 5 * odd[at])[:, None] + np.arange(body.shape[1])] = body
    return struct.pack("<QQ", n, blocks) + start[:-1].astype("<u8").tobytes() + out.tobytes()


def unpack(image: bytes | memoryview, only: range | None = None) -> np.ndarray:
    """What ``pack`` packed, or the blocks ``only`` of it, found by the index."""
    n, blocks = struct.unpack_from("<QQ", image)
    if not n:
        return np.zeros(0, np.uint32)
    start = np.frombuffer(image, "<u8", blocks, 16).astype(np.int64)
    data = np.frombuffer(image, np.uint8, offset=16 + 8 * blocks)
    chosen = np.arange(blocks) if only is None else np.asarray(only)
    start = start[chosen]
    head = data[start[:, None] + np.arange(6)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4").reshape(-1)
    width, odd = head[:, 4], head[:, 5].astype(np.int64)
    out = np.zeros((len(chosen), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        at = np.nonzero(width == w)[0]
        body = data[(start[at] + 6 + 5 * odd[at])[:, None] + np.arange(BLOCK // 8 * int(w))]
        bits = np.zeros((len(at), BLOCK, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(body, axis=1, bitorder="little").reshape(len(at), BLOCK, w)
        out[at] = np.packbits(bits, axis=2, bitorder="little").view("<u4").reshape(len(at), BLOCK)
    if odd.any():
        row = np.repeat(np.arange(len(chosen)), odd)
        to = start[row] + 6 + 5 * (np.arange(len(row)) - np.repeat(np.cumsum(odd) - odd, odd))
        out[row, data[to]] = np.ascontiguousarray(data[to[:, None] + 1 + np.arange(4)]).view("<u4").reshape(-1)
    out += least[:, None]
    flat = out.reshape(-1)
    return flat[: n - int(chosen[0]) * BLOCK] if only is None or chosen[-1] == blocks - 1 else flat


def segment(doc_ids: list[int], ids: list[bytes]) -> bytes:
    lengths, packed = pack(np.array([len(x) // 4 for x in ids], np.uint32)), pack(np.frombuffer(b"".join(ids), "<u4"))
    return _MAGIC + struct.pack("<QQ", len(doc_ids), len(lengths)) + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.packbits([d is None for d in doc_ids]).tobytes() + lengths + packed


def documents_of(image: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a segment: their doc_id and ids."""
    if image[:4] != _MAGIC:
        raise ValueError("not a segment of token ids")
    n, size = struct.unpack_from("<QQ", image, 4)
    at = 20 + 8 * n + -(-n // 8)
    none = np.unpackbits(np.frombuffer(image, np.uint8, -(-n // 8), 20 + 8 * n), count=n).tolist()
    ends = np.cumsum(unpack(memoryview(image)[at : at + size]).astype(np.int64))
    ids = unpack(memoryview(image)[at + size :])
    for doc, null, end, before in zip(np.frombuffer(image, "<i8", n, 20).tolist(), none, ends, [0, *ends[:-1]]):
        yield None if null else doc, ids[before:end]


SEGMENTS = "part int, nth long, before long, n_ids long, image binary"
DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """Encodes ``docs`` in ascending doc_id order with the vocabulary at ``path`` and writes the segments; returns the written table."""

    def run(batches):
        encode, part = encoder(path, end).encode, TaskContext.get().partitionId()
        nth = before = held = 0
        doc_ids: list[int] = []
        ids: list[bytes] = []

        def closed():
            row = [[part], [nth], [before], [held], [segment(doc_ids, ids)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "nth", "before", "n_ids", "image"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(encode(text.as_py()))
                doc_ids.append(doc)
                held += len(ids[-1]) // 4
                if held >= SEGMENT_IDS:
                    yield closed()
                    nth, before, held, doc_ids, ids = nth + 1, before + held, 0, [], []
        if doc_ids:
            yield closed()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return staged(ordered.mapInArrow(run, SEGMENTS), "tokens")


def read(segments: DataFrame) -> DataFrame:
    """Start, length and checksum of each document's ids, read back from the written segments."""

    def run(batches):
        for batch in batches:
            for first, before, image in zip(batch.column("first").to_pylist(), batch.column("before").to_pylist(), batch.column("image")):
                rows, at = [], first + before
                for doc, ids in documents_of(image.as_py()):
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row for each writing task, not for each document
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return segments.join(F.broadcast(first), "part").select("first", "before", "image").mapInArrow(run, DIGESTS)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json")))
