"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly, groups of equal texts stay together.

Each group has a vector (bytes, tokens, rows), taken as shares of the whole. Groups are placed in descending order of their largest weighted share, each
in the shard where the weighted dot product of its vector with what is left of the shard's capacity is highest. Groups over ``1 / (shards * FINE)`` of
the whole in some dimension, of which there are at most ``3 * shards * FINE``, have each their own vector. The others are a histogram on the driver: a
class for each step of a fifth in bytes, of tokens to bytes and of rows, with how many groups it has and their mean vector. A class's groups are
placed in ``CHUNKS`` turns by its mean vector, and its groups take the places in the order of their hashes; so every group has a place of its own, and
the plan's size depends on the number of steps, not on that of groups. A group over a whole shard's capacity can't stay together under the law; it
alone is dealt by its rows into ``PARTS`` parts, and its rows say so in ``split``.

The law is ``bytes``. Nulls count as empty texts, of size 1; repeated rows of a doc_id belong to the same group and keep a slot each; rows without a
doc_id are sharded like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, staged, table

FINE = 512
#: Turns in which the groups of a class are placed, for each shard.
CHUNKS = 8
PARTS = 256
_SHARES = ("bytes", "tokens", "rows")
#: How much each share counts in the order of groups and in the dot product; the law is on bytes.
WEIGHTS = np.array([16.0, 1.0, 1.0])


def place(shares: np.ndarray, counts: np.ndarray, shards: int) -> list[list[tuple[int, int]]]:
    """For each vector of shares, the runs (number of groups, shard) of the groups that have it; equal vectors are placed in the given order."""
    left = np.full((shards, shares.shape[1]), 1 / shards)
    out: list[list[tuple[int, int]]] = [[] for _ in shares]
    for i in np.argsort(-(WEIGHTS * shares).max(axis=1), kind="stable"):
        todo, turn = int(counts[i]), -(-int(counts[i]) // (shards * CHUNKS))
        while todo:
            n, s = min(todo, turn), int(np.argmax(left @ (WEIGHTS * shares[i])))
            left[s] -= n * shares[i]
            out[i].append((n, s))
            todo -= n
    return out


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row, and whether its group is split."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.unhex(F.sha2(text, 256)).alias("group"),
    )
    rows = staged(rows, "sizes")
    total = rows.agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    most = F.greatest(*[F.col(k) / F.lit(float(max(1, total[k] or 0))) for k in _SHARES])
    groups = rows.groupBy("group").agg(*sums)
    # at most 3 * shards groups are over a shard's capacity
    split = [r.group for r in groups.where(most > 1 / shards).select("group").collect()]
    part = F.when(F.col("group").isin(split), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).otherwise(F.lit(0)) if split else F.lit(0)
    rows = rows.withColumn("part", part.cast("int"))
    units = rows.groupBy("group", "part").agg(*sums)
    # a class of its own for each large group, of which there are at most 3 * shards * FINE; the steps bound the others
    step = lambda x, k: F.floor(F.log2(x + 1) * k).cast("int")
    rough = F.concat_ws(" ", step(F.col("bytes"), 4), F.round(16 * F.col("tokens") / F.col("bytes")).cast("int"), step(F.col("rows"), 2))
    name = F.when(most > 1 / (shards * FINE), F.concat_ws(" ", F.hex("group"), "part")).otherwise(rough)
    units = staged(units.withColumn("class", name), "groups")
    classes = units.groupBy("class").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in _SHARES]).orderBy("class").collect()
    vectors = np.array([[r[k] / r.n / max(1, total[k]) for k in _SHARES] for r in classes]).reshape(-1, 3)
    runs = []
    for r, found in zip(classes, place(vectors, np.array([r.n for r in classes], np.int64), shards)):
        ends = np.cumsum([n for n, _ in found]).tolist()
        runs.append((r["class"], [(end, s) for end, (_, s) in zip(ends, found)]))
    runs = spark.createDataFrame(runs, "class string, runs array<struct<end:long,shard:int>>")  # one row for each class
    ranked = numbered(units.select("group", "part", "class"), ["class"], ["group", "part"], "_rank", sum(r.n for r in classes))
    places = ranked.join(F.broadcast(runs), "class").select("group", "part", F.filter("runs", lambda r: F.col("_rank") < r.end)[0]["shard"].alias("shard"))
    placed = rows.join(places, ["group", "part"]).withColumn("split", F.col("group").isin(split) if split else F.lit(False))
    return numbered(placed.select("doc_id", "size", "text_crc32", "shard", "split"), ["shard"], ["doc_id"], "slot", total["rows"])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
