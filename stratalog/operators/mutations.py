"""Dry runs of changes to files: where moved files go, and what becomes of tags, path-keyed choices and scopes."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.patterns import NamePattern

_STEM = r"(?s)^(.+)\.([^.]*)$"


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ancestors(path: Column) -> Column:
    """All proper ancestors of an absolute path, without the empty one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, 1, n), "/")))


def _family(name: Column) -> tuple[Column, Column]:
    """What all names share that can be variants of each other: the stem without numbers at its end, and the extension."""
    split = name.rlike(_STEM)
    stem = F.when(split, F.regexp_extract(name, _STEM, 1)).otherwise(name)
    return F.regexp_replace(stem, r"( \d+)+\z", "").alias("_stem"), F.when(split, F.concat(F.lit("."), F.regexp_extract(name, _STEM, 2))).otherwise("").alias("_ext")


def transfers(files: DataFrame, dest: str, on_disk: DataFrame, policy: str = "keep_both") -> DataFrame:
    """(path, target) for each of ``files`` (path) that goes to ``dest``, whose names are ``on_disk`` (name).

    Files under ``dest`` and folders above it stay where they are. In the order of their paths, files get the first free of name, "stem 2.ext",
    "stem 3.ext" and so on, however many; with ``skip`` names on disk stay behind, with ``replace`` the first file takes the name. Names can only clash
    within a family of one stem, so each family goes through one task, after its names on disk and by path. The task holds a family's different names,
    not its files.
    """
    if policy not in ("keep_both", "skip", "replace"):
        raise ValueError(f"no such policy: {policy}")
    dest = dest.rstrip("/")
    above = F.startswith(F.lit(dest + "/"), F.concat("path", F.lit("/")))
    moved = files.where(~(names.path_under(F.col("path"), dest) | above)).select("path", leaf(F.col("path")).alias("name"))
    disk_first = moved.unionByName(on_disk.where("name is not null").select(F.lit(None).cast("string").alias("path"), "name"))
    ordered = disk_first.select(*_family(F.col("name")), "path", "name").repartition("_stem", "_ext").sortWithinPartitions("_stem", "_ext", F.col("path").asc_nulls_first())

    def fold(batches):
        # Of the family: names on disk, names that files took as they are, and the last number given (or passed over) after each name.
        family, disk, plain, at = None, set(), set(), {}
        for batch in batches:
            paths, targets = [], []
            for *key, path, name in zip(*(c.to_pylist() for c in batch.columns)):
                if key != family:
                    family, disk, plain, at = key, set(), set(), {}
                if path is None:
                    disk.add(name)
                    continue
                clash = name in disk
                if clash and policy == "skip":
                    continue
                found = re.match(_STEM, name)
                stem, ext = (found[1], "." + found[2]) if found else (name, "")
                free = None
                if name not in at:
                    at[name] = 1
                    variant = re.fullmatch(r"(?s)(.+) ([1-9][0-9]{0,17})", stem)
                    claimed = not clash and variant and 1 < int(variant[2]) <= at.get(variant[1] + ext, 1)
                    if not claimed and (not clash or policy == "replace"):
                        plain.add(name)
                        free = name
                while free is None:
                    at[name] += 1
                    tried = f"{stem} {at[name]}{ext}"
                    if tried not in disk and tried not in plain:
                        free = tried
                paths.append(path)
                targets.append(f"{dest}/{free}")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(targets, pa.string())], ["path", "target"])

    return ordered.mapInArrow(fold, "path string, target string")


def undone(operations: DataFrame) -> DataFrame:
    """The operations (position, op, source, target) that take applied ones back, last first: moves and renames swap their ends, copies and new folders go, deleted ones return."""
    op = F.col("op")
    swapped = op.isin("move", "rename")
    back = F.when(swapped, op).when(op.isin("copy", "create"), "delete").when(op == "delete", "restore")
    place = F.when(op == "delete", F.col("source")).otherwise(F.col("target"))
    return operations.select((-F.col("position")).alias("position"), back.alias("op"), place.alias("source"), F.when(swapped, F.col("source")).alias("target"))


def migrated_tags(tags: DataFrame, operations: DataFrame) -> DataFrame:
    """``tags`` (path, tag) after ``operations`` (op, source, target), at most one for a path: moves and renames take tags along, copies have them as well, deletions end them."""
    joined = tags.join(operations.select("op", F.col("source").alias("path"), "target"), "path", "left")
    kept = F.when(F.col("op").isNull() | (F.col("op") == "copy"), F.col("path"))
    gone = F.when(F.col("op") != "delete", F.col("target"))
    return joined.select(F.explode(F.array_compact(F.array(kept, gone))).alias("path"), "tag").distinct()


def remapped(entries: DataFrame, source: str, target: str, copy: bool = False) -> DataFrame:
    """``entries`` with a path after ``source`` and all below it went to ``target``; what was there before under the same path is replaced."""
    source, target, path = source.rstrip("/"), target.rstrip("/"), F.col("path")
    under = names.path_under(path, source)
    new = entries.where(under).withColumn("path", F.concat(F.lit(target), F.substring(path, F.lit(len(source) + 1), F.length(path))))
    old = entries if copy else entries.where(~under)
    return old.join(new.select("path"), "path", "left_anti").select(*entries.columns).unionByName(new)


def absorbed(scopes: DataFrame) -> DataFrame:
    """The distinct paths of ``scopes`` that have none of the others above them."""
    scopes = scopes.select("path").distinct()
    below = scopes.select("path", F.explode(F.array_compact(ancestors(F.col("path")))).alias("above")).join(scopes.select(F.col("path").alias("above")), "above", "left_semi")
    return scopes.join(below, "path", "left_anti")


def widened(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """(path, scope): for each distinct path of ``wanted`` the longest of itself and its ancestors that is ``present``; paths outside all of these are left out."""
    chain = wanted.select("path").distinct().select("path", F.explode(F.array_append(F.array_compact(ancestors(F.col("path"))), F.col("path"))).alias("scope"))
    return chain.join(present.select(F.col("path").alias("scope")), "scope", "left_semi").groupBy("path").agg(F.max_by("scope", F.length("scope")).alias("scope"))


MOST_OPERATIONS = 1000


class Refused(ValueError):
    """Why a plan is not made."""


def renamed(files: DataFrame, pattern: NamePattern) -> DataFrame:
    """source, name and unchanged (which are skipped) of a batch of files in the order of their paths. Batches of none or of more than MOST_OPERATIONS files are refused, as are
    patterns that give all files one name, names that can't be and two files of one new path. The batch is read once, at most one row more than the limit."""
    rows = files.select("path").limit(MOST_OPERATIONS + 1).collect()
    count = len(rows)
    if not count:
        raise Refused("no matches")
    if count > MOST_OPERATIONS:
        raise Refused("too many")
    if count > 1 and not pattern.varies:
        raise Refused("one name for all")
    batch = files.sparkSession.createDataFrame(rows, "path string")
    n = F.row_number().over(Window.orderBy("path"))
    name = pattern.render(leaf(F.col("path")), n, F.lit(len(str(count))))
    made = batch.withColumn("name", name).withColumn("unchanged", F.col("name") == leaf(F.col("path")))
    folder = F.regexp_replace("path", "[^/]*$", "")
    faults = made.agg(
        F.count_if(~names.valid_file_name(F.col("name"))).alias("invalid"),
        F.count_if("unchanged").alias("same"),
        (F.count("*") - F.count_distinct(F.concat(folder, F.col("name")))).alias("collisions"),
    ).first()
    for fault, why in (("invalid", "invalid name"), ("collisions", "collision")):
        if faults[fault]:
            raise Refused(why)
    if faults["same"] == count:
        raise Refused("nothing to do")
    return made.select(F.col("path").alias("source"), "name", "unchanged")
