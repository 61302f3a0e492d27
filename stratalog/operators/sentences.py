"""Sentences run over catalogs with paths: folders by their spoken names, the files that a selection means, answers to questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.commands import HERE, Destination, Question, Selection
from ..functions.phrases import lower

LARGEST = 50


def _lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _near(inside: DataFrame, name: str) -> str | None:
    """The path of the one folder inside whose name is closest, by the rule of ``names.nearest``; at most six rows reach the driver."""
    limit = 2 if len(name) >= 8 else 1
    like = inside.where(F.abs(F.length("name") - len(name)) <= limit).withColumn("_far", names.swaps_distance_to(name, limit)("name")).where(F.col("_far") <= limit)
    same = _lowered(F.substring("name", 1, 1)) == lower(name[:1])
    groups = like.groupBy("_far", same.alias("same")).agg(F.count_distinct("name").alias("n"), F.min("path").alias("path")).collect()
    least = min((r["_far"] for r in groups), default=0)
    close = [r for r in groups if r["_far"] == least]
    if least == 0 or not close:
        return None
    if sum(r["n"] for r in close) == 1:
        return close[0]["path"]
    return next((r["path"] for r in close if r["same"] and r["n"] == 1), None)


def resolved(place: Destination, folders: DataFrame, shown: str) -> str | None:
    """The path that a spoken place is, seen from the folder ``shown``: an absolute path of a folder; a folder inside, in its letter case or another; one further below;
    the folder itself for words such as "here"; a new one; or the one folder inside whose name is nearest. None for anything else."""
    found = folders.where("is_dir")
    if place.name.startswith("/"):
        path = "/" + "/".join(x for x in place.name.split("/") if x)
        return None if found.where(F.col("path") == path).isEmpty() else path
    below = shown.rstrip("/") + "/"
    inside = found.where(F.startswith("path", F.lit(below)) & (F.length("path") == len(below) + F.length("name")))
    spelled = inside.where(_lowered(F.col("name")) == lower(place.name)).orderBy((F.col("name") != place.name).cast("int"), "id").select("path").head()
    if spelled:
        return spelled["path"]
    if "/" in place.name and not found.where(F.col("path") == below + place.name).isEmpty():
        return below + place.name
    if place.create:
        return below + place.name if "/" not in place.name and place.name not in (".", "..") else None
    return shown if lower(place.name) in HERE else _near(inside, place.name)


def selected(of: Selection, records: DataFrame, shown: str = "/", tagged: DataFrame | None = None, picked: DataFrame | None = None) -> DataFrame:
    """The records of a catalog with paths that a selection means, root records left out; ``tagged`` has (path, tag), ``picked`` the paths of picked files."""
    if of.picked:
        if picked is None:
            raise ValueError("nothing is selected")
        return records.join(picked.select("path").distinct(), "path", "left_semi")
    out = records.where(F.col("parent") != 0).where(of.query.where())
    if of.within:
        scope = resolved(of.within, records, shown)
        if scope is None:
            raise ValueError(f"no folder called {of.within.name!r}")
        out = out.where(names.path_under(F.col("path"), scope))
    if of.text:
        out = out.where(names.tier(F.col("name"), of.text).isNotNull())
    for tag in of.query.tags:
        if tagged is None:
            raise ValueError("tags are needed")
        out = out.join(tagged.where(F.lower("tag") == tag).select("path").distinct(), "path", "left_semi")
    return out


def answered(question: Question, records: DataFrame, shown: str = "/", tagged: DataFrame | None = None, picked: DataFrame | None = None) -> DataFrame:
    """(n), (n, bytes), or the largest files as (id, path, size). A size's words that name a folder mean all in it."""
    of = question.of
    if question.folder and not of.within and (scope := resolved(Destination(of.source), records, shown)):
        found = records.where(names.path_under(F.col("path"), scope) & (F.col("path") != scope))
    else:
        found = selected(of, records, shown, tagged, picked)
    files = found.where("not is_dir")
    match question.asks:
        case "count":
            return found.agg(F.count("*").alias("n"))
        case "size":
            return files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return files.where("size is not null").orderBy(F.desc("size"), "id").limit(question.top or LARGEST).select("id", "path", "size")
