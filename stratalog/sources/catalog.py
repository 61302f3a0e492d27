"""The catalog of records over the given tables: regions are roots, nations and customers directories, orders files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names

#: Extensions of files by the first digit of an order's priority.
EXTENSIONS = {"1": "pdf", "2": "png", "3": "txt", "4": "zip", "5": "rs"}
COLUMNS = ("id", "parent", "root", "name", "is_dir", "size", "mtime")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(df: DataFrame, id_, parent, root, name, is_dir, size, mtime) -> DataFrame:
    values = (id_, parent, root, name, F.lit(is_dir), size, mtime)
    kinds = ("long", "long", "long", "string", "boolean", "long", "long")
    return df.select(*[v.cast(k).alias(c) for v, k, c in zip(values, kinds, COLUMNS)])


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record: id, parent (0: a root record), root, name, is_dir, size and mtime (null where unknown)."""
    none = F.lit(None)
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    root_of_nation = nation.select("n_nationkey", (F.col("n_regionkey") + 1).alias("root"))
    customers = customer.join(root_of_nation, F.col("c_nationkey") == F.col("n_nationkey"))
    root_of_customer = customers.select("c_custkey", "root")
    files = orders.join(root_of_customer, F.col("o_custkey") == F.col("c_custkey"))
    extension = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[F.substring("o_orderpriority", 1, 1)]
    name = F.concat(F.lit("order_"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("."), extension)
    size = F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") * 100))
    parts = [
        _records(region, F.col("r_regionkey") + 1, F.lit(0), F.col("r_regionkey") + 1, F.col("r_name"), True, none, none),
        _records(nation, F.col("n_nationkey") + 1000, F.col("n_regionkey") + 1, F.col("n_regionkey") + 1, F.col("n_name"), True, none, none),
        _records(customers, F.col("c_custkey") + 1_000_000, F.col("c_nationkey") + 1000, F.col("root"), F.col("c_name"), True, none, none),
        _records(files, F.col("o_orderkey") + 1_000_000_000, F.col("o_custkey") + 1_000_000, F.col("root"), name, False, size, F.floor(names.seconds(F.col("o_orderdate")))),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


#: The same records in DuckDB's SQL, for use as the first common table expressions of a query.
CATALOG_SQL = """
catalog AS MATERIALIZED (
  SELECT (1 + r_regionkey)::BIGINT AS id, 0::BIGINT AS parent, (1 + r_regionkey)::BIGINT AS root, r_name AS name, true AS is_dir, NULL::BIGINT AS size, NULL::BIGINT AS mtime FROM region
  UNION ALL SELECT (1000 + n_nationkey)::BIGINT, (1 + n_regionkey)::BIGINT, (1 + n_regionkey)::BIGINT, n_name, true, NULL, NULL FROM nation
  UNION ALL SELECT 1000000 + c_custkey, (1000 + c_nationkey)::BIGINT, (1 + n_regionkey)::BIGINT, c_name, true, NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 1000000000 + o_orderkey, 1000000 + o_custkey, (1 + n_regionkey)::BIGINT,
    'order_' || lpad(o_orderkey::VARCHAR, 8, '0') || '.' || CASE o_orderpriority[1] WHEN '1' THEN 'pdf' WHEN '2' THEN 'png' WHEN '3' THEN 'txt' WHEN '4' THEN 'zip' WHEN '5' THEN 'rs' END,
    false, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice * 100)::BIGINT END, epoch(o_orderdate)::BIGINT
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

#: Paths as well: root, then names from above.
PATHS_SQL = (
    CATALOG_SQL
    + """,
paths AS MATERIALIZED (
  SELECT c.*, CASE WHEN c.parent = 0 THEN '/' || c.name WHEN p.parent = 0 THEN '/' || p.name || '/' || c.name
    WHEN g.parent = 0 THEN '/' || g.name || '/' || p.name || '/' || c.name ELSE '/' || r.name || '/' || g.name || '/' || p.name || '/' || c.name END AS path
  FROM catalog c LEFT JOIN catalog p ON c.parent = p.id LEFT JOIN catalog g ON p.parent = g.id LEFT JOIN catalog r ON g.parent = r.id)"""
)
