"""Tags and visits: tables beside the catalog that are keyed by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE = 30 * 86400
PARENT_CREDIT = 0.25


def with_all_tags(tags: DataFrame, required: list[str]) -> DataFrame:
    """Paths of ``tags`` (path, tag) that have all of ``required``, case ignored; none where nothing is required."""
    wanted = sorted({r.lower() for r in required})
    if not wanted:
        return tags.select("path").limit(0)
    return tags.where(F.lower("tag").isin(wanted)).groupBy("path").agg(F.count_distinct(F.lower("tag")).alias("n")).where(F.col("n") == len(wanted)).select("path")


def distinct_tags(tags: DataFrame) -> DataFrame:
    """Each tag once by its name in lower case, as the first path spells it."""
    return tags.groupBy(F.lower("tag").alias("key")).agg(F.min_by("tag", F.struct("path", "tag")).alias("tag"), F.count_distinct("path").alias("n"))


def decayed(weight: Column, age_seconds: Column) -> Column:
    return weight * F.pow(F.lit(0.5), F.greatest(age_seconds, F.lit(0)) / HALF_LIFE)


def scores(visits: DataFrame, now: int) -> DataFrame:
    """Of visits (path, parent, t): each visit credits its path and a quarter its parent; credits halve in thirty days."""
    credit = visits.select("path", F.lit(1.0).alias("w"), "t").union(visits.where("parent is not null").select("parent", F.lit(PARENT_CREDIT), "t"))
    return credit.groupBy("path").agg(F.sum(decayed(F.col("w"), F.lit(now) - F.col("t"))).alias("score"))


def kept_scores(scored: DataFrame, most: int = 200) -> DataFrame:
    return scored.orderBy(F.desc("score"), "path").limit(most)


def recent(visits: DataFrame, most: int = 20) -> DataFrame:
    """The paths opened last, newest first, with their ``position``."""
    last = visits.groupBy("path").agg(F.max("t").alias("last_opened")).orderBy(F.desc("last_opened"), "path").limit(most)
    return last.withColumn("position", F.row_number().over(Window.orderBy(F.desc("last_opened"), "path")).cast("long"))


#: Colours by their number in a system tag, which decide results.
COLOURS = ("Grey", "Green", "Purple", "Blue", "Yellow", "Red", "Orange")


def system_tag(entry: Column) -> Column:
    """Name and colour of a system's tag, whose last line is a number up to 7; 0 and entries without one have no colour."""
    number = F.regexp_extract(entry, r"(?s)^.*\n\+?0*([0-7])$", 1)
    colours = F.array(*[F.lit(c) for c in COLOURS])
    numbered = F.struct(F.regexp_extract(entry, r"(?s)^(.*)\n[^\n]*$", 1).alias("name"), F.get(colours, number.try_cast("int") - 1).alias("color"))
    return F.when(number != "", numbered).otherwise(F.struct(entry.alias("name"), F.lit(None).cast("string").alias("color")))


def with_tag(tags: Column, new: Column, replacing: Column | None = None) -> Column:
    """An array of tags (structs of name and color) with a new one: in the place of the first of the name replaced, else at the end; no other tag has its name."""
    others = lambda part: F.filter(part, lambda t: t["name"] != new["name"])
    if replacing is None:
        return F.concat(others(tags), F.array(new))
    at = F.array_position(F.transform(tags, lambda t: t["name"]), replacing).cast("int")
    before = others(F.slice(tags, 1, F.greatest(at - 1, F.lit(0))))
    after = F.filter(F.slice(tags, at + 1, F.size(tags)), lambda t: (t["name"] != new["name"]) & (t["name"] != replacing))
    return F.when(at > 0, F.concat(before, F.array(new), after)).otherwise(F.concat(others(tags), F.array(new)))


def without_tag(tags: Column, name: Column | None = None) -> Column:
    """The array without tags of a name, whatever the case of its ASCII letters; without a name, empty."""
    ascii_lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(tags, lambda t: F.lit(False) if name is None else ascii_lower(t["name"]) != ascii_lower(name))
