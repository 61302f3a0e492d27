"""Packed lists, and tables of letters by which the rows of staged tables send them to each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(values: np.ndarray) -> bytes:
    """Integers byte by byte, which compresses best."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(np.asarray(values).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def packed_sorted(values: np.ndarray) -> bytes:
    """Ascending integers, by their steps."""
    return packed(np.diff(values.astype(np.int64), prepend=0))


def unpacked_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw))


BINARY = "abcdef"
MAIL = "to long, sender long, kind int, sums array<double>, " + ", ".join(f"{c} binary" for c in BINARY)
_MAIL = pa.schema([("to", pa.int64()), ("sender", pa.int64()), ("kind", pa.int32()), ("sums", pa.list_(pa.float64())), *[(c, pa.binary()) for c in BINARY]])


def post(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist([{"sums": None} | dict.fromkeys(BINARY) | r for r in rows], _MAIL)


def posted(rows):
    """Record batches of letters, a few in each."""
    rows = iter(rows)
    while some := [r for _, r in zip(range(256), rows)]:
        yield from post(some).to_batches()


def letters(mail: pa.Table, kind: int) -> list[dict]:
    """The letters of a kind, by sender."""
    return sorted((r for r in mail.to_pylist() if r["kind"] == kind), key=lambda r: r["sender"])


def sent(mail: DataFrame, kind: int) -> DataFrame:
    return mail.where(F.col("kind") == kind)


def cuts(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and where each but the first begins."""
    present, starts = np.unique(sorted_, return_index=True)
    return present, starts[1:]
