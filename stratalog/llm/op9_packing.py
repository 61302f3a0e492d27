"""Packing of token sequences by matching large items, then best fit.

Pieces longer than a third of the capacity pair at most twice per sequence: the longest is matched with the longest that still fits beside it.
Shorter pieces go, longest first, into the tightest gap that holds them, and then into new sequences. Only the number of pieces of each length
decides this, so the plan is made from a histogram of at most ``capacity`` rows, whatever the number of pieces; each piece finds its
place from its rank among the pieces of its length. A plan's rows are runs of equal placements, which number in the lengths, not in the pieces.

Null and empty texts have the end id alone; texts over the capacity are cut, others never. Repeated rows are packed each on their own; an
empty table packs into nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, staged, table
from .tokens import encoder, vocabulary_path

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, pieces per sequence, offset): piece number first + i goes to sequence
    first sequence + i // pieces per sequence, at offset + (i % pieces per sequence) * length."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: runs of sequences (first, number)
    sizes: list[int] = []  # the gaps that have sequences, ascending
    sequences = 0

    def place(length: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n, first, each, offset))
        used[length] += n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append((first, n))

    large = sorted(x for x in counts if 3 * x > capacity)
    left = {x: counts[x] for x in large}
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        b = large[k] if k >= 0 else None
        n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
        if b == a and not n:  # one is left over; the next shorter one may fit beside it
            b = large[k - 1] if k >= 1 else None
            n = 1
        place(a, n, sequences, 1, 0)
        left[a] -= n
        if b is not None:
            place(b, n, sequences, 1, a)
            left[b] -= n
        leave(capacity - a - (b or 0), sequences, n)
        sequences += n
        large = [x for x in large if left[x]]
    for x in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        n = counts[x]
        while n:
            k = bisect_left(sizes, x)
            if k == len(sizes):
                gap, first, free = capacity, sequences, -(-n // (capacity // x))
                sequences += free
            else:
                gap = sizes[k]
                first, free = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(k)
            each = gap // x
            full = min(free, n // each)
            if full:
                place(x, full * each, first, each, capacity - gap)
                leave(gap - each * x, first, full)
                n -= full * each
            if n and full < free:
                place(x, n, first + full, n, capacity - gap)
                leave(gap - n * x, first + full, 1)
                full, n = full + 1, 0
            leave(gap, first + full, free - full)
    return runs


def pieces(docs: DataFrame, path: str, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document's ids, in order, none longer than ``capacity``."""

    def run(batches):
        encode = encoder(path, end).encode
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py())
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"]) if rows else pa.RecordBatch.from_pydict({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Each piece of ``docs`` with its sequence and its offset there."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, path, end, capacity), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    by_length: dict[int, list] = defaultdict(list)
    for length, *rest in plan(counts, capacity):
        by_length[length].append(rest)
    schema = "length long, runs array<struct<lo:long,hi:long,sequence:long,each:long,offset:long>>"
    runs = spark.createDataFrame([(k, [tuple(x) for x in v]) for k, v in by_length.items()], schema)  # at most `capacity` rows
    ranked = numbered(cut, ["length"], ["doc_id", "piece"], "_rank", sum(counts.values()))
    found = ranked.join(F.broadcast(runs), "length").withColumn("_run", F.filter("runs", lambda r: (r.lo <= F.col("_rank")) & (F.col("_rank") < r.hi))[0])
    nth, each = F.col("_rank") - F.col("_run.lo"), F.col("_run.each")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_run.sequence") + F.floor(nth / each)).alias("sequence_id"), (F.col("_run.offset") + nth % each * F.col("length")).alias("offset"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
