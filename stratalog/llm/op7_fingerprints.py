"""Homomorphic multiset hashes of documents.

A document is the multiset of its paragraphs: the lines that hold more than white space. Each paragraph is hashed to a wide vector, and a
fingerprint is the sum of these vectors, lane by lane modulo a power of two. Paragraphs can so be added and taken away without the rest of the
text, and their order does not matter. A vector has two parts: ``EQUAL`` lanes of 32 random bits, which tell whether two multisets are equal, and
``ALIKE`` lanes of +1 or -1 modulo 2**16, whose squared distance estimates how many paragraphs differ. The likeness of two fingerprints is
1 - |a - b|**2 / (|a|**2 + |b|**2) over the latter, within 0 and 1, and 1 exactly where all lanes are equal. It is the share of paragraphs
in common, give or take sqrt(2 / ALIKE).

Nulls count as empty texts, which have no paragraph and the fingerprint 0. Rows of one doc_id follow each other in the order of their texts.
A table's only document is its own next one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

EQUAL = 16
ALIKE = 128
_POWER = 1 << 32
#: Documents that a bucket of consecutive doc_ids holds on average, and how many buckets there can be.
BUCKET_ROWS = 1000
MOST_BUCKETS = 4096


def lanes(text: Column) -> Column:
    """The summed vector of a text's paragraphs: EQUAL lanes modulo 2**32, then ALIKE lanes, each in signed form."""

    def summed(hashes: Column) -> Column:
        equal = F.transform(F.sequence(F.lit(0), F.lit(EQUAL - 1)), lambda i: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a + h[i]).bitwiseAND(F.lit(_POWER - 1))))
        signs = F.transform(
            F.sequence(F.lit(0), F.lit(ALIKE - 1)),
            lambda i: let(F.floor(i / 32).cast("int") + EQUAL, lambda word: let((i % 32).cast("int"), lambda bit: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + 1 - 2 * F.getbit(h[word], bit)))),
        )
        return F.concat(equal, F.transform(signs, lambda x: F.pmod(x + 32768, F.lit(65536)) - 32768))

    def words(digest: Column, n: int) -> list[Column]:
        return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]

    paragraphs = F.filter(F.split(text, "\n"), lambda p: F.btrim(p, F.lit(" \t\x0b\x0c\r")) != "")
    # the lanes are the words of a paragraph's digest, the signs the bits of that one's digest
    hashed = F.transform(paragraphs, lambda p: let(F.sha2(p, 512), lambda s: let(F.sha2(s, 256), lambda t: F.array(*words(s, EQUAL), *words(t, ALIKE // 32)))))
    return let(hashed, summed)


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of two multisets together, or of the first without the second."""
    both = F.zip_with(a, b, lambda x, y: x + sign * y)
    return F.transform(both, lambda x, i: F.when(i < EQUAL, F.pmod(x, F.lit(_POWER))).otherwise(F.pmod(x + 32768, F.lit(65536)) - 32768))


def likeness(a: Column, b: Column) -> Column:
    def of(a: Column, b: Column) -> Column:
        pairs = F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), EQUAL + 1, ALIKE)
        both = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, p: s + p["a"] * p["a"] + p["b"] * p["b"])
        apart = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, p: s + let(F.pmod(p["a"] - p["b"] + 32768, F.lit(65536)) - 32768, lambda d: d * d))
        return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - apart / F.greatest(both, F.lit(1))))

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def printed(vector: Column) -> Column:
    """A fingerprint as text: 8 hexadecimal digits for each lane of the first part, 4 for each of the second."""
    return F.array_join(F.transform(vector, lambda x, i: F.when(i < EQUAL, F.lpad(F.hex(x), 8, "0")).otherwise(F.lpad(F.hex(F.pmod(x, F.lit(65536))), 4, "0"))), "")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column>: what the next row has by (doc_id, text), and the first for the last one.

    Buckets of consecutive doc_ids, cut at quantiles, are ordered each on its own; a bucket's last row takes the first row of the next one
    that isn't empty, from a table of one row a bucket.
    """
    rows = docs.count()
    depth = min(MOST_BUCKETS, max(1, rows // BUCKET_ROWS)).bit_length() - 1
    buckets = 1 << depth
    bucket = F.lit(0)
    if buckets > 1:
        bounds = docs.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0]
        steps = F.lit([1 << k for k in reversed(range(depth))])
        bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.element_at(F.lit(bounds), at + step) <= F.col("doc_id"), at + step).otherwise(at))
    docs = docs.withColumn("_bucket", bucket)
    order = Window.partitionBy("_bucket").orderBy("doc_id", "text")
    row = F.struct(*columns)
    first = docs.groupBy("_bucket").agg(F.min_by(row, F.struct("doc_id", "text")).alias("_row"))
    over = Window.orderBy("_bucket")  # one row for each bucket
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = first.select("_bucket", F.coalesce(F.lead("_row").over(over), F.first("_row").over(whole)).alias("_follows"))
    out = docs.withColumn("_next", F.lead(row).over(order)).join(follows, "_bucket")
    return out.withColumn("_next", F.coalesce("_next", "_follows")).select(*docs.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, half = F.col("n_chars"), F.floor(F.col("n_chars") / 2).cast("int")
    paired = with_next(docs.withColumn("lanes", lanes(F.col("text"))), ["text", "lanes"]).withColumn("n_chars", F.char_length("text"))
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next_text", F.lit(1), half))
    made = paired.select("doc_id", n.cast("long").alias("n_chars"), "lanes", "next_lanes", let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), lanes(e).alias("lanes"))).alias("edited"))
    return made.select(
        "doc_id",
        "n_chars",
        F.col("edited.sha").alias("edited_sha256"),
        printed(F.col("lanes")).alias("fingerprint"),
        printed(F.col("edited.lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited.lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
