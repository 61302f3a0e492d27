"""Ingestion of changes as a stream: each micro-batch is one level in a folder, and the catalog is read as the base with all levels above it.

A change has a sequence (its place in the log, from 1), op (upsert or delete) and the columns of a record. A batch is written under its
number and overwrites what an ended attempt left there, so a batch that runs again gives the same levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalogs


def newest(changes: DataFrame) -> DataFrame:
    """The last change of each id."""
    others = [c for c in changes.columns if c != "id"]
    return changes.groupBy("id").agg(F.max_by(F.struct(*others), "sequence").alias("_c")).select("id", "_c.*").select(*changes.columns)


def ingest(changes: DataFrame, levels: str, checkpoint: str) -> StreamingQuery:
    """Starts to write a stream of changes below ``levels``, and ends with the changes that are there."""

    def commit(batch: DataFrame, number: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{levels}/batch={number}")

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, base: DataFrame, levels: str) -> DataFrame:
    """The catalog as it stands: ``base`` is level 0, each change stands at its sequence."""
    made = spark.read.option("basePath", levels).parquet(levels).drop("batch").withColumnRenamed("sequence", "level")
    under = base.select(F.lit(0).cast("long").alias("level"), F.lit("upsert").alias("op"), "*")
    return catalogs.live(under.unionByName(made))


def gaps(log: DataFrame, key: str) -> DataFrame:
    """(key, sequence, missing): where the log of a key goes on after a gap, and how many entries it lacks."""
    step = F.col("sequence") - F.lag("sequence").over(Window.partitionBy(key).orderBy("sequence"))
    return log.select(key, "sequence", (step - 1).alias("missing")).where("missing > 0")


def bursts(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """(key, began, ended, n) for each run of events no further apart than ``gap``; streams drop what comes later than ``late``."""
    window = F.session_window(time, gap)
    runs = events.withWatermark(time, late).groupBy(key, window.alias("_w")).agg(F.count("*").alias("n"))
    return runs.select(key, F.col("_w.start").alias("began"), F.col("_w.end").alias("ended"), "n")


def first_sightings(operations: DataFrame, time: str, late: str) -> DataFrame:
    """Each operation_id once, remembered for as long as ``late``."""
    return operations.withWatermark(time, late).dropDuplicatesWithinWatermark(["operation_id"])


def retry_delay(failures: Column, first: int = 30, most: int = 900) -> Column:
    """Seconds to wait after so many failures in a row: they double up to a limit."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(30))), F.lit(most)).cast("long")
