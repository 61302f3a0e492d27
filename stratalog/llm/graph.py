"""Connected components of a graph that stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ends of ``edges`` (a, b); a component is named by its least id.

    Each round takes the least name among a vertex and its neighbours, then the name of that name, so that the rounds grow as the logarithm of
    the diameter on chains and are few on stars. Tables between rounds are written to the shared folder.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    names = staged(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "names")
    while True:
        near = both.join(names.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        taken = names.join(near, "id").select("id", F.least("component", "m").alias("next"), "component")
        jumped = taken.join(taken.select(F.col("id").alias("next"), F.col("next").alias("far")), "next", "left")
        made = staged(jumped.select("id", F.least("next", F.coalesce("far", "next")).alias("next"), "component"), "names")
        changed = made.where("next <> component").limit(1).count()
        names = made.select("id", F.col("next").alias("component"))
        if not changed:
            return names
