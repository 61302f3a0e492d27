"""Shared plumbing of the text operators: the shared work folder, staged tables, lambda bindings, gapless numbering."""

from __future__ import annotations

import atexit
import functools
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one numbering block holds on average.
BLOCK_ROWS = 20_000


@functools.lru_cache(maxsize=8)
def _local_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"stratalog-{application}-")
    atexit.register(shutil.rmtree, folder, True)
    return "file://" + folder


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; where it is unset, on a master of one JVM only, a temporary one of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder(spark.sparkContext.applicationId)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/stratalog/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``staged`` has written for ``df``, once all that is read from it has been written elsewhere."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it (also within lambdas)."""
    return F.transform(F.array(value), body)[0]


def numbered(df: DataFrame, groups: list[str], order: list[str], into: str, rows: int) -> DataFrame:
    """Adds ``into``: gapless numbers from 0 in each group, with no group in one task.

    Rows are dealt by hash into blocks within each group; a table of block counts (rows / BLOCK_ROWS per group at most) gives each block's
    first number. Ties in ``order`` within a block are numbered arbitrarily.
    """
    blocks = max(1, -(-rows // BLOCK_ROWS))
    df = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    before = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = df.groupBy(*groups, "_block").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(*groups, "_block").orderBy(*order))
    keys = [*groups, "_block"]
    return df.withColumn("_row", within - 1).join(first.drop("_n"), keys).withColumn(into, (F.col("_first") + F.col("_row")).cast("long")).drop("_block", "_row", "_first")


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished, staged steps now, not when the driver next happens to collect its garbage; its cleaner has a moment for that."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)
