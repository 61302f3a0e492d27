"""A corpus pipeline over the text operators: quality rules, one document of each near-duplicate class, repeated passages cut, a mix of
domains, and packing. Every stage reads all that the one before it kept, from Parquet, and all but the last return the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import op1_chosen_path, op3_mixing, op4_quality, op6_passages, op9_packing
from stratalog.llm.common import shared_path, table
from stratalog.llm.tokens import vocabulary_path


def _of(docs: DataFrame, verdicts: DataFrame, *keys: str) -> DataFrame:
    """``docs`` joined with ``verdicts`` on doc_id, version (the text's hash) and ``keys``, where nulls are equal: rows that are equal in these are judged alike."""
    names = ["doc_id", "version", *keys]
    verdicts = verdicts.select(*[F.col(c).alias(f"_{c}") for c in names], *[c for c in verdicts.columns if c not in names])
    on = F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col("_version"))
    for c in ("doc_id", *keys):
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return docs.join(verdicts, on)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep, also those without an id."""
    kept = op4_quality.judged(docs, table(spark, sf_dir, "labels")).where("kept").select("doc_id", "version", "lang").distinct()
    return _of(docs, kept, "lang").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of the join the first document, by doc_id (none last) and version of the text, once; documents without words stay, equal rows once."""
    verdicts = op1_chosen_path.join(docs).groupBy("doc_id", "version").agg(F.first("stays").alias("_stays"), F.count("*").alias("_rows")).where("_stays")
    rows = _of(docs, verdicts)
    once, often = rows.where("_rows = 1").select(*docs.columns), rows.where("_rows > 1").select(*docs.columns)
    return once.unionByName(often.dropDuplicates(["doc_id", "text"]))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has; documents without an id stay as they are."""
    return op6_passages.cut(docs, op6_passages.passages(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the probability of its rate, which is 1 at most: the good domain stays, the others shrink to their weights."""
    rated = op3_mixing.rates(docs, table(spark, sf_dir, "labels"), most=1.0, keep="good")
    chance = F.pmod(F.xxhash64("doc_id", "version", F.lit("mixing")), F.lit(1 << 20)) / (1 << 20)
    kept = rated.where(chance < F.col("rate")).select("doc_id", "version").distinct()
    return _of(docs, kept).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: where each piece of each document stands."""
    return op9_packing.pack(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]
#: SQL can't express the join, the passages, the classifier or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex[:8]}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
