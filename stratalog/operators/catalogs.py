"""Operators over catalogs of records: paths, search, questions, merge on read, validation."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names

#: Levels above a record that are walked; what hangs deeper, or in a circle, is left out.
MOST_LEVELS = 4096
#: Literal hits from which on names that only resemble the needle are not looked for.
ENOUGH = 10


def _cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder of spark.checkpoint.dir; in a temporary one where that is unset, on a master of one JVM only."""
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stratalog-"))
    return df.checkpoint()


def directories(records: DataFrame) -> DataFrame:
    """(id, path) of the directories that reach a root record.

    Each step joins every directory with the one that it has come to, which has come as far itself, so that steps double the levels walked; only
    directories take part, and the plan is cut after every two steps that leave some on the way.
    """
    out, levels = records.where("is_dir").select("id", F.col("parent").alias("up"), F.concat(F.lit("/"), "name").alias("path")), 1
    while True:
        for _ in range(2):
            above = out.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("path").alias("_path"))
            arrived = F.col("up") == 0
            out = out.join(above, F.col("up") == F.col("_id"), "left").where(arrived | F.col("_id").isNotNull())
            out = out.select("id", F.when(arrived, F.lit(0)).otherwise(F.col("_up")).alias("up"), F.when(arrived, F.col("path")).otherwise(F.concat("_path", "path")).alias("path"))
            levels *= 2
        if levels >= MOST_LEVELS or out.where("up <> 0").isEmpty():
            return out.where("up = 0").select("id", "path")
        out = _cut(out)


def with_paths(records: DataFrame) -> DataFrame:
    """Adds ``path``; records that reach no root record within MOST_LEVELS have none and are left out."""
    above = directories(records).select(F.col("id").alias("_above"), F.col("path").alias("_path"))
    out = records.join(above, F.col("parent") == F.col("_above"), "left").where("parent = 0 or _above is not null")
    return out.withColumn("path", F.concat(F.coalesce("_path", F.lit("")), F.lit("/"), "name")).drop("_above", "_path")


def ranked(records: DataFrame, needle: str, where: Column | None = None, limit: int = 100, offset: int = 0, hot: DataFrame | None = None, ascii_only: bool = False, fuzzy: bool = False) -> DataFrame:
    """The page of a ranked name search, with ``rank`` from 1: by tier, recent use, folded length, folded name, id. Root records are no hits. With ``fuzzy``, names that
    resemble the needle follow where it has less than ENOUGH literal hits."""
    hits = records.where("parent <> 0")
    if where is not None:
        hits = hits.where(where)
    tier = names.tier(F.col("name"), needle, ascii_only)
    if fuzzy and names.fold_text(needle) and hits.where(tier.isNotNull()).limit(ENOUGH).count() < ENOUGH:
        tier = F.coalesce(tier, F.when(names.resembles(F.col("name"), needle, ascii_only), F.lit(names.TIERS.index("fuzzy"))))
    hits = hits.withColumn("tier", tier).where("tier is not null").withColumn("_fold", names.fold(F.col("name"), ascii_only))
    hits = hits.join(F.broadcast(hot.select("id", "hot").limit(512)), "id", "left") if hot is not None else hits.withColumn("hot", F.lit(None).cast("long"))
    order = [F.col("tier"), F.coalesce("hot", F.lit(0)).desc(), F.octet_length("_fold"), F.col("_fold"), F.col("id")]
    page = hits.orderBy(*order).limit(offset + limit)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).where(F.col("rank") > offset).drop("_fold")


def live(levels: DataFrame, check_parents: bool = True) -> DataFrame:
    """The records of ``levels`` (level, op, record columns) as they stand: the newest level of each id, without deleted ones and what hangs below them."""
    columns = [c for c in levels.columns if c not in ("level", "op")]
    newest = levels.groupBy("id").agg(F.max_by(F.struct("op", *[c for c in columns if c != "id"]), "level").alias("_r")).select("id", "_r.*").where("op <> 'delete'").drop("op")
    newest = newest.select(*columns)
    if not check_parents:
        return newest
    reached = directories(newest).select(F.col("id").alias("parent"))
    return newest.where("parent = 0").unionByName(newest.join(reached, "parent", "left_semi").select(*columns))


def shadowed(older: DataFrame, newer: DataFrame) -> DataFrame:
    """The older rows that no newer level has."""
    return older.join(newer.select("id").distinct(), "id", "left_anti")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row for each id that differs: upsert or delete."""
    fields = [c for c in before.columns if c != "id"]
    a, b = before.select("id", F.struct(*fields).alias("_a")), after.select("id", F.struct(*fields).alias("_b"))
    both = a.join(b, "id", "full_outer")
    op = F.when(F.col("_b").isNull(), "delete").when(F.col("_a").isNull() | ~F.col("_a").eqNullSafe(F.col("_b")), "upsert")
    return both.select("id", op.alias("op")).where("op is not null")


def violations(records: DataFrame) -> DataFrame:
    """(check, violations): what a catalog must not have, with how often it has it."""
    parents = records.select(F.col("id").alias("parent"), F.col("is_dir").alias("_dir"), F.col("root").alias("_root"))
    linked = records.where("parent <> 0").join(parents, "parent", "left")
    of = {
        "duplicate_id": records.groupBy("id").count().where("count > 1"),
        "zero_id": records.where("id = 0"),
        "nul_in_name": records.where(F.col("name").contains("\x00")),
        "root_not_directory": records.where("parent = 0 and not is_dir"),
        "roots_per_root": records.where("parent = 0").groupBy("root").count().where("count > 1"),
        "missing_parent": linked.where("_dir is null"),
        "parent_not_directory": linked.where("not _dir"),
        "other_root_than_parent": linked.where("_root <> root"),
    }
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(k).alias("check"), "violations") for k, df in of.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def posting_keys(records: DataFrame) -> DataFrame:
    """(key, n): how many records have each root, kind, extension, size class and day."""
    name, ext = F.col("name"), names.extension(F.col("name"))
    keys = F.array(
        F.concat(F.lit("r:"), F.col("root")),
        F.concat(F.lit("k:"), names.kind(name, F.col("is_dir"))),
        F.when(~F.col("is_dir"), F.concat(F.lit("e:"), ext)),
        F.concat(F.lit("s:"), names.bits(F.col("size"))),
        F.concat(F.lit("m:"), names.day(F.col("mtime"))),
    )
    return records.select(F.explode(F.array_compact(keys)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def listing(entries: DataFrame, by: str = "name", descending: bool = False, directories_first: bool = True) -> DataFrame:
    """Adds ``position``: directories first, then by the key, ties by name upwards whatever the direction, then by id."""
    kinds = ("Directory", "Image", "Video", "Audio", "Archive", "Code", "Document", "Other")
    rank = F.array_position(F.lit(list(kinds)), names.kind(F.col("name"), F.col("is_dir")))
    keys = {"name": [F.lower("name")], "size": [F.coalesce("size", F.lit(0))], "modified": [F.col("mtime")], "kind": [rank, names.extension_after_dot(F.col("name"))]}[by]
    order = ([F.col("is_dir").desc()] if directories_first else []) + [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]
    return entries.withColumn("position", F.row_number().over(Window.partitionBy("parent").orderBy(*order, F.lower("name"), F.col("id"))).cast("long"))


def folders_like(folders: DataFrame, name: str, most: int = 3) -> DataFrame:
    """The closest folders by spelling: names within two edits or a third of the name's bytes, nearest first, then by name."""
    limit = max(2, len(name.encode()) // 3)
    lengths = F.length("name").between(len(name) - limit, len(name) + limit)
    near = folders.where(lengths).select("name").distinct().where(F.levenshtein(F.lower("name"), F.lit(name.lower()), 2 * limit) >= 0)
    return near.select(names.swaps_distance_to(name, limit)("name").alias("distance"), "name").where(F.col("distance") <= limit).orderBy("distance", "name").limit(most)
