"""All queries of the catalog engine by name, with their SQL.

Each entry is a function of (spark, sf_dir) and, where SQL can express it, DuckDB's SQL over the same tables.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import addresses, areas, commands, grammar, names, patterns, phrases
from ..operators import catalogs, mutations, sentences, side_tables
from ..sources.catalog import CATALOG_SQL, PATHS_SQL, catalog, table
from ..streaming import changes

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
_NOW_EVENTS = 1706659200  # 2024-01-31
_CATALOG, _PATHS = f"WITH {CATALOG_SQL}", f"WITH {PATHS_SQL}"
_KIND_SQL = "CASE WHEN is_dir THEN 'Directory' WHEN name LIKE '%.png' THEN 'Image' WHEN name LIKE '%.zip' THEN 'Archive' WHEN name LIKE '%.rs' THEN 'Code' WHEN name LIKE '%.pdf' OR name LIKE '%.txt' THEN 'Document' ELSE 'Other' END"


def _query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- search ---------------------------------------------------------------------------------------------------------------------------


def _tier_sql(needle: str) -> str:
    """Tiers of catalog names: their words start after anything that is neither letter nor digit, and at capitals after small letters."""
    return f"""CASE WHEN lower(name) = '{needle}' THEN 0 WHEN starts_with(lower(name), '{needle}') THEN 1
      WHEN contains(lower(name), '{needle}') THEN CASE WHEN len(list_filter(range(1, len(name) + 1), lambda i: starts_with(lower(name[i:]), '{needle}') AND (i = 1
        OR (regexp_matches(name[i], '[A-Za-z0-9]') AND NOT regexp_matches(name[i - 1], '[A-Za-z0-9]'))
        OR (regexp_matches(name[i], '[A-Z]') AND regexp_matches(name[i - 1], '[a-z]'))
        OR (regexp_matches(name[i], '[A-Z]') AND regexp_matches(name[i - 1], '[A-Z]') AND regexp_matches(name[i + 1], '[a-z]'))))) > 0 THEN 2 ELSE 3 END END"""


def _ranked_sql(needle: str, where: str = "true", limit: int = 100, offset: int = 0) -> str:
    return f"""{_CATALOG}, hits AS (SELECT *, {_tier_sql(needle)} AS tier FROM catalog WHERE parent <> 0 AND {where})
    SELECT rank, id, name, tier FROM (SELECT id, name, tier, row_number() OVER (ORDER BY tier, strlen(lower(name)), lower(name), id) AS rank FROM hits WHERE tier IS NOT NULL) WHERE rank > {offset} AND rank <= {offset + limit}"""


def _page(df: DataFrame) -> DataFrame:
    return df.select("rank", "id", "name", F.col("tier").cast("int").alias("tier"))


@_query("ranked_search_ascii", _ranked_sql("0012"))
def _(s: SparkSession, d: str):
    return _page(catalogs.ranked(catalog(s, d), "0012", ascii_only=True))


@_query("ranked_search_filtered", _ranked_sql("order", "size >= 10485760 AND name LIKE '%.pdf'", 50, 10))
def _(s, d):
    where = (F.col("size") >= 10485760) & (names.extension(F.col("name")) == "pdf")
    return _page(catalogs.ranked(catalog(s, d), "order", where, 50, 10, ascii_only=True))


@_query("stream_literal", f"{_CATALOG} SELECT id, name FROM catalog WHERE parent <> 0 AND contains(lower(name), '77')")
def _(s, d):
    return catalog(s, d).where((F.col("parent") != 0) & names.tier(F.col("name"), "77", True).isNotNull()).select("id", "name")


@_query("no_match_search", _ranked_sql("zqxjw"))
def _(s, d):
    return _page(catalogs.ranked(catalog(s, d), "zqxjw", ascii_only=True))


@_query("tier_histogram", f"{_CATALOG}, hits AS (SELECT {_tier_sql('01')} AS tier FROM catalog WHERE parent <> 0) SELECT tier, count(*) AS n FROM hits GROUP BY tier")
def _(s, d):
    return catalog(s, d).where("parent <> 0").groupBy(names.tier(F.col("name"), "01", True).cast("int").alias("tier")).agg(F.count("*").alias("n"))


@_query("name_dictionary", "SELECT lower(p_name) AS folded, count(*) AS n, list_aggregate(list(p_partkey ORDER BY p_partkey), 'string_agg', ',') AS ids FROM part GROUP BY 1")
def _(s, d):
    rows = table(s, d, "part").groupBy(names.fold(F.col("p_name")).alias("folded")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("p_partkey")).alias("ids"))
    return rows.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@_query("one_edit_matches", "SELECT DISTINCT p_name AS name, w AS word FROM (SELECT p_name, unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE levenshtein(w, 'bold') <= 1")
def _(s, d):
    rows = table(s, d, "part").select(F.col("p_name").alias("name"), F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return rows.where(names.one_edit(F.col("word"), F.lit("bold"))).distinct()


@_query("delete_keys", "SELECT DISTINCT 'd:' || k AS key FROM (SELECT w AS k FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE len(w) BETWEEN 3 AND 24 UNION SELECT w[1:i - 1] || w[i + 1:] FROM (SELECT DISTINCT w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE len(w) BETWEEN 3 AND 24))")
def _(s, d):
    words = table(s, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct().where(F.length("w").between(3, 24))
    return words.select(F.explode(F.array_union(F.array("w"), names.deletions(F.col("w")))).alias("k")).select(F.concat(F.lit("d:"), "k").alias("key")).distinct()


@_query("swap_distance")
def _(s, d):
    words = table(s, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    return words.withColumn("distance", names.swaps_distance_to("glod", 2)(F.col("word"))).where("distance <= 2")


@_query("trigram_candidates", "SELECT key, count(DISTINCT name) AS n FROM (SELECT name, name[i:i + 2] AS key FROM (SELECT DISTINCT lower(p_name) AS name, unnest(range(1, len(p_name) - 1)) AS i FROM part)) GROUP BY key")
def _(s, d):
    rows = table(s, d, "part").select(F.lower("p_name").alias("name")).distinct().where(F.length("name") >= 3)
    grams = rows.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.substring(F.col("name"), i, F.lit(3)))).alias("key"))
    return grams.groupBy("key").agg(F.count_distinct("name").alias("n"))


@_query("locality_rerank", f"""{_PATHS}, hits AS (SELECT id, path, {_tier_sql('00')} AS tier, CASE WHEN starts_with(path, '/ASIA/') THEN 0 ELSE 1 END AS locality FROM paths WHERE parent <> 0 AND NOT is_dir)
  SELECT id, locality, row_number() OVER (ORDER BY tier, locality, id) AS rank FROM hits WHERE tier IS NOT NULL QUALIFY rank <= 100""")
def _(s, d):
    hits = catalogs.with_paths(catalog(s, d)).where("parent <> 0 and not is_dir").withColumn("tier", names.tier(F.col("name"), "00", True)).where("tier is not null")
    hidden = F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda p: F.startswith(p, F.lit(".")))
    locality = F.when(names.path_under(F.col("path"), "/ASIA"), 0).otherwise(1) + F.when(hidden, 2).otherwise(0)
    order = ("tier", "locality", "id")
    page = hits.withColumn("locality", locality).orderBy(*order).limit(100)
    return page.select("id", "locality", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


# --- filters --------------------------------------------------------------------------------------------------------------------------


def _filter(name: str, sql: str, where):
    @_query(name, f"{_CATALOG} SELECT id, name FROM catalog WHERE parent <> 0 AND {sql}")
    def _(s, d):
        return catalog(s, d).where(F.col("parent") != 0).where(where()).select("id", "name")


_filter("filter_kind", f"{_KIND_SQL} = 'Document'", lambda: names.kind(F.col("name"), F.col("is_dir")) == "Document")
_filter("filter_ext", "name LIKE '%.png'", lambda: names.extension(F.col("name")) == "png")
_filter("filter_size_range", "size BETWEEN 10000000 AND 20000000", lambda: F.col("size").between(10000000, 20000000))
_filter("filter_modified_range", "mtime >= 852076800 AND mtime < 883612800", lambda: (F.col("mtime") >= 852076800) & (F.col("mtime") < 883612800))
_filter("filter_conjunction", "name LIKE '%.zip' AND size > 5000000 AND mtime < 883612800", lambda: (names.kind(F.col("name"), F.col("is_dir")) == "Archive") & (F.col("size") > 5000000) & (F.col("mtime") < 883612800))
_filter("null_metadata_never_matches", "size >= 0 AND NOT is_dir", lambda: (F.col("size") >= 0) & ~F.col("is_dir"))
_filter("glob_filter", "lower(name) LIKE 'order\\_0000%.t_t' ESCAPE '\\'", lambda: names.glob(F.col("name"), "ORDER_0000*.t?t"))


# --- hierarchy ------------------------------------------------------------------------------------------------------------------------


@_query("materialized_paths", f"{_PATHS} SELECT id, path FROM paths")
def _(s, d):
    return catalogs.with_paths(catalog(s, d)).select("id", "path")


@_query("scope_members", f"{_PATHS} SELECT id, path FROM paths WHERE path = '/EUROPE' OR starts_with(path, '/EUROPE/')")
def _(s, d):
    return catalogs.with_paths(catalog(s, d)).where(names.path_under(F.col("path"), "/EUROPE/")).select("id", "path")


@_query("children_of", f"{_CATALOG} SELECT id, name, row_number() OVER (ORDER BY name) AS position FROM catalog WHERE parent = 1003")
def _(s, d):
    return catalog(s, d).where("parent = 1003").select("id", "name", F.row_number().over(Window.orderBy("name")).cast("long").alias("position"))


@_query("child_lookup", f"{_CATALOG} SELECT c.id, c.name FROM catalog c JOIN (SELECT n_name AS name, (1 + n_regionkey)::BIGINT AS parent FROM nation WHERE n_nationkey % 5 = 0) w USING (name, parent)")
def _(s, d):
    wanted = table(s, d, "nation").where("n_nationkey % 5 = 0").select(F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).cast("long").alias("parent"))
    return catalog(s, d).join(wanted, ["name", "parent"]).select("id", "name")


@_query("root_counts", f"{_CATALOG} SELECT root, count(*) AS n FROM catalog WHERE parent <> 0 GROUP BY root")
def _(s, d):
    return catalog(s, d).where("parent <> 0").groupBy("root").agg(F.count("*").alias("n"))


@_query("tree_size", f"{_CATALOG} SELECT root, sum(size)::BIGINT AS bytes FROM catalog GROUP BY root")
def _(s, d):
    return catalog(s, d).groupBy("root").agg(F.sum("size").alias("bytes"))


@_query("breadcrumbs", f"{_PATHS} SELECT id, len(string_split(path, '/')) - 1 AS depth, string_split(path, '/')[2] AS first, string_split(path, '/')[-1] AS last FROM paths")
def _(s, d):
    parts = F.split("path", "/")
    return catalogs.with_paths(catalog(s, d)).select("id", (F.size(parts) - 1).cast("long").alias("depth"), parts[1].alias("first"), F.element_at(parts, -1).alias("last"))


# --- questions and listings -----------------------------------------------------------------------------------------------------------


@_query("question_count", f"{_CATALOG} SELECT count(*) AS n FROM catalog WHERE parent <> 0 AND NOT is_dir AND name LIKE '%.pdf'")
def _(s, d):
    return catalog(s, d).where("parent <> 0 and not is_dir").where(names.extension(F.col("name")) == "pdf").agg(F.count("*").alias("n"))


@_query("question_size", f"{_CATALOG} SELECT count(*) AS n, sum(size)::BIGINT AS bytes FROM catalog WHERE parent <> 0 AND NOT is_dir AND mtime >= 852076800")
def _(s, d):
    return catalog(s, d).where("parent <> 0 and not is_dir and mtime >= 852076800").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@_query("question_largest", f"{_CATALOG} SELECT id, size, row_number() OVER (ORDER BY size DESC, id) AS rank FROM catalog WHERE NOT is_dir AND size IS NOT NULL QUALIFY rank <= 50")
def _(s, d):
    order = (F.desc("size"), F.col("id"))
    top = catalog(s, d).where("not is_dir and size is not null").orderBy(*order).limit(50)
    return top.select("id", "size", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def _listing(by: str, descending: bool, key: str):
    way = "DESC NULLS LAST" if descending else "ASC NULLS FIRST"

    @_query(f"listing_by_{by}", f"{_CATALOG} SELECT id, row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, {', '.join(k + ' ' + way for k in key.split(';'))}, lower(name), id) AS position FROM catalog")
    def _(s, d):
        return catalogs.listing(catalog(s, d), by, descending).select("id", "position")


_listing("name", False, "lower(name)")
_listing("size", True, "coalesce(size, 0)")
_listing("modified", False, "mtime")
_listing("kind", False, f"list_position(['Directory', 'Image', 'Video', 'Audio', 'Archive', 'Code', 'Document', 'Other'], {_KIND_SQL});CASE WHEN contains(name, '.') THEN regexp_extract(name, '\\.([^.]*)$', 1) ELSE '' END")


@_query("posting_keys", f"""{_CATALOG} SELECT key, count(*) AS n FROM (
  SELECT 'r:' || root AS key FROM catalog UNION ALL SELECT 'k:' || ({_KIND_SQL}) FROM catalog UNION ALL SELECT 'e:' || regexp_extract(name, '\\.([^.]*)$', 1) FROM catalog WHERE NOT is_dir
  UNION ALL SELECT 's:' || (CASE WHEN size = 0 THEN 0 ELSE len(bin(size)) END) FROM catalog WHERE size IS NOT NULL UNION ALL SELECT 'm:' || floor(mtime / 86400)::BIGINT FROM catalog WHERE mtime IS NOT NULL) GROUP BY key""")
def _(s, d):
    return catalogs.posting_keys(catalog(s, d))


@_query("corpus_report", f"{_CATALOG} SELECT count(*) AS entries, count(*) FILTER (WHERE is_dir) AS dirs, count(DISTINCT name) AS names, count(DISTINCT lower(name)) AS folded, sum(strlen(name))::BIGINT AS name_bytes, sum(size)::BIGINT AS bytes FROM catalog")
def _(s, d):
    return catalog(s, d).agg(F.count("*").alias("entries"), F.count_if("is_dir").alias("dirs"), F.count_distinct("name").alias("names"), F.count_distinct(F.lower("name")).alias("folded"), F.sum(F.octet_length("name")).alias("name_bytes"), F.sum("size").alias("bytes"))


@_query("length_histogram", "SELECT CASE WHEN n_chars = 0 THEN 0 ELSE len(bin(n_chars)) END::INT AS bucket, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    return table(s, d, "documents").groupBy(names.bits(F.col("n_chars")).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@_query("format_size", f"{_CATALOG} SELECT id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0::DOUBLE) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0::DOUBLE) ELSE printf('%.1f GB', size / 1073741824.0::DOUBLE) END AS label FROM catalog WHERE size IS NOT NULL")
def _(s, d):
    return catalog(s, d).where("size is not null").select("id", names.format_size(F.col("size")).alias("label"))


@_query("file_families", f"{_CATALOG} SELECT CASE WHEN name LIKE '%.pdf' THEN 'PDF' WHEN name LIKE '%.png' THEN 'Image' WHEN name LIKE '%.txt' THEN 'Text' WHEN name LIKE '%.zip' THEN 'Archive' ELSE 'Code' END AS family, count(*) AS n FROM catalog WHERE NOT is_dir GROUP BY 1")
def _(s, d):
    return catalog(s, d).where("not is_dir").groupBy(names.family(F.col("name")).alias("family")).agg(F.count("*").alias("n"))


@_query("modified_months", f"{_CATALOG} SELECT strftime(make_timestamp(mtime * 1000000), '%Y-%m') AS bucket, count(*) AS n FROM catalog WHERE NOT is_dir GROUP BY 1")
def _(s, d):
    return catalog(s, d).where("not is_dir").groupBy(F.date_format(F.date_from_unix_date(names.day(F.col("mtime")).cast("int")), "yyyy-MM").alias("bucket")).agg(F.count("*").alias("n"))


# --- merge on read --------------------------------------------------------------------------------------------------------------------


def _levels(s: SparkSession, d: str) -> DataFrame:
    """The catalog as level 0, and two levels of changes to its orders and customers from the events."""
    base = catalog(s, d).select(F.lit(0).alias("level"), F.lit("upsert").alias("op"), "*")
    events = table(s, d, "events")
    target = (F.col("event_id") % F.lit(15000) + 1_000_000_000).alias("id")
    changes = events.select((F.col("event_id") % 2 + 1).cast("int").alias("level"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), target, "event_id")
    newest = changes.groupBy("level", "id").agg(F.max_by("op", "event_id").alias("op"), F.max("event_id").alias("e"))
    files = base.where("not is_dir").select("id", "parent", "root", "name", "is_dir", "mtime")
    made = newest.join(files, "id").select("level", "op", "id", "parent", "root", F.concat(F.lit("new_"), "name").alias("name"), "is_dir", F.col("e").alias("size"), "mtime")
    dirs = base.where("is_dir and parent >= 1000 and id % 10 = 3").select(F.lit(3).alias("level"), F.lit("delete").alias("op"), *[c for c in base.columns if c not in ("level", "op")])
    return base.unionByName(made).unionByName(dirs)


_LEVELS_SQL = (
    _CATALOG
    + """, changes AS (
  SELECT (event_id % 2 + 1)::INT AS level, (event_id % 15000 + 1000000000)::BIGINT AS id, arg_max(CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END, event_id) AS op, max(event_id) AS e FROM events GROUP BY 1, 2),
levels AS MATERIALIZED (
  SELECT 0 AS level, 'upsert' AS op, * FROM catalog
  UNION ALL SELECT level, op, id, parent, root, 'new_' || name, is_dir, e, mtime FROM changes JOIN (SELECT id, parent, root, name, is_dir, mtime FROM catalog WHERE NOT is_dir) USING (id)
  UNION ALL SELECT 3, 'delete', * FROM catalog WHERE is_dir AND parent >= 1000 AND id % 10 = 3),
newest AS MATERIALIZED (SELECT * FROM levels QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1),
present AS MATERIALIZED (SELECT * EXCLUDE (level, op) FROM newest WHERE op <> 'delete'),
live AS MATERIALIZED (SELECT c.* FROM present c LEFT JOIN present p ON c.parent = p.id LEFT JOIN present g ON p.parent = g.id LEFT JOIN present r ON g.parent = r.id
  WHERE c.parent = 0 OR p.parent = 0 OR g.parent = 0 OR r.parent = 0)"""
)


@_query("live_view", f"{_LEVELS_SQL} SELECT id, name, size FROM live")
def _(s, d):
    return catalogs.live(_levels(s, d)).select("id", "name", "size")


@_query("merged_levels", f"{_LEVELS_SQL} SELECT id, name, size FROM present")
def _(s, d):
    return catalogs.live(_levels(s, d), check_parents=False).select("id", "name", "size")


@_query("orphans_hidden", f"{_LEVELS_SQL} SELECT id FROM present WHERE id NOT IN (SELECT id FROM live)")
def _(s, d):
    levels = _levels(s, d)
    return catalogs.live(levels, False).select("id").join(catalogs.live(levels).select("id"), "id", "left_anti")


@_query("shadowed_rows", f"{_LEVELS_SQL} SELECT id FROM levels WHERE level = 0 AND id NOT IN (SELECT id FROM levels WHERE level > 0)")
def _(s, d):
    levels = _levels(s, d)
    return catalogs.shadowed(levels.where("level = 0"), levels.where("level > 0")).select("id")


@_query("flush_delta", f"{_LEVELS_SQL} SELECT id, op FROM levels WHERE level > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1")
def _(s, d):
    changed = _levels(s, d).where("level > 0").groupBy("id").agg(F.max_by("op", "level").alias("op"))
    older = _levels(s, d).where("level = 0").select("id")
    return changed.where("op <> 'delete'").unionByName(changed.where("op = 'delete'").join(older, "id", "left_semi"))


@_query("snapshot_diff", f"{_LEVELS_SQL} SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'delete' ELSE 'upsert' END AS op FROM catalog a FULL JOIN live b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.name <> b.name OR a.size IS DISTINCT FROM b.size")
def _(s, d):
    return catalogs.difference(catalog(s, d), catalogs.live(_levels(s, d)))


@_query("live_root_counts", f"{_LEVELS_SQL} SELECT root, count(*) AS n FROM live WHERE parent <> 0 GROUP BY root")
def _(s, d):
    return catalogs.live(_levels(s, d)).where("parent <> 0").groupBy("root").agg(F.count("*").alias("n"))


@_query("validate_catalog", f"""{_CATALOG} SELECT 'duplicate_id' AS "check", count(*) AS violations FROM (SELECT id FROM catalog GROUP BY id HAVING count(*) > 1)
  UNION ALL SELECT 'zero_id', count(*) FROM catalog WHERE id = 0 UNION ALL SELECT 'nul_in_name', count(*) FROM catalog WHERE contains(name, chr(0)) UNION ALL SELECT 'root_not_directory', count(*) FROM catalog WHERE parent = 0 AND NOT is_dir
  UNION ALL SELECT 'roots_per_root', count(*) FROM (SELECT root FROM catalog WHERE parent = 0 GROUP BY root HAVING count(*) > 1)
  UNION ALL SELECT 'missing_parent', count(*) FROM catalog WHERE parent <> 0 AND parent NOT IN (SELECT id FROM catalog)
  UNION ALL SELECT 'parent_not_directory', count(*) FROM catalog c JOIN catalog p ON c.parent = p.id WHERE NOT p.is_dir
  UNION ALL SELECT 'other_root_than_parent', count(*) FROM catalog c JOIN catalog p ON c.parent = p.id WHERE c.root <> p.root""")
def _(s, d):
    return catalogs.violations(catalog(s, d))


@_query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@_query("log_gaps", "SELECT user_id, event_id, event_id - prior AS gap FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prior FROM events) WHERE event_id - prior > 300")
def _(s, d):
    prior = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(s, d, "events").select("user_id", "event_id", (F.col("event_id") - prior).alias("gap")).where("gap > 300")


# --- tags and visits ------------------------------------------------------------------------------------------------------------------


def _tags(s, d):
    labels = table(s, d, "labels")
    path = F.concat(F.lit("doc:"), F.col("doc_id")).alias("path")
    return labels.select(path, F.when(F.col("quality") == 1, "Good").otherwise("Low").alias("tag")).union(labels.where("toxic = 1").select(path, F.lit("toxic")))


_TAGS_SQL = "WITH tags AS (SELECT 'doc:' || doc_id AS path, CASE WHEN quality = 1 THEN 'Good' ELSE 'Low' END AS tag FROM labels UNION ALL SELECT 'doc:' || doc_id, 'toxic' FROM labels WHERE toxic = 1)"


@_query("tags_all_required", f"{_TAGS_SQL} SELECT path FROM tags WHERE lower(tag) IN ('good', 'toxic') GROUP BY path HAVING count(DISTINCT lower(tag)) = 2")
def _(s, d):
    return side_tables.with_all_tags(_tags(s, d), ["good", "TOXIC"])


@_query("distinct_tags", f"{_TAGS_SQL} SELECT lower(tag) AS key, min(tag) AS tag, count(DISTINCT path) AS n FROM tags GROUP BY 1")
def _(s, d):
    return side_tables.distinct_tags(_tags(s, d))


@_query("tag_prune", f"{_TAGS_SQL} SELECT path, tag FROM tags WHERE path IN (SELECT 'doc:' || doc_id FROM documents WHERE n_chars > 1000)")
def _(s, d):
    present = table(s, d, "documents").where("n_chars > 1000").select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("path"))
    return _tags(s, d).join(present, "path", "left_semi").select("path", "tag")


def _visits(s, d):
    return table(s, d, "events").select(F.concat(F.lit("/"), F.col("user_id"), F.lit("/"), F.col("event_type")).alias("path"), F.concat(F.lit("/"), F.col("user_id")).alias("parent"), F.floor(names.seconds(F.col("ts"))).alias("t"))


_VISITS_SQL = "WITH visits AS (SELECT '/' || user_id || '/' || event_type AS path, '/' || user_id AS parent, floor(epoch(ts))::BIGINT AS t FROM events), credit AS (SELECT path, 1.0::DOUBLE AS w, t FROM visits UNION ALL SELECT parent, 0.25::DOUBLE, t FROM visits)"


@_query("frecency_scores", f"{_VISITS_SQL} SELECT path, round(sum(w * pow(0.5, greatest({_NOW_EVENTS} - t, 0) / 2592000.0::DOUBLE)), 4) AS score FROM credit GROUP BY path")
def _(s, d):
    return side_tables.scores(_visits(s, d), _NOW_EVENTS).withColumn("score", F.round("score", 4))


@_query("recent_paths", f"{_VISITS_SQL} SELECT path, max(t) AS last_opened, row_number() OVER (ORDER BY max(t) DESC, path) AS position FROM visits GROUP BY path QUALIFY position <= 20")
def _(s, d):
    return side_tables.recent(_visits(s, d))


# --- plans and changes ----------------------------------------------------------------------------------------------------------------


@_query("plan_rename", f"{_PATHS} SELECT path AS source, 'scan-' || lpad(row_number() OVER (ORDER BY path)::VARCHAR, len((count(*) OVER ())::VARCHAR)::INT, '0') || '.png' AS name FROM paths WHERE name LIKE '%.png' AND starts_with(path, '/ASIA/')")
def _(s, d):
    files = catalogs.with_paths(catalog(s, d)).where(names.path_under(F.col("path"), "/ASIA") & (names.extension(F.col("name")) == "png"))
    width = files.agg(F.length(F.count("*").cast("string")).alias("width"))
    n = F.row_number().over(Window.orderBy("path")).cast("string")
    return files.withColumn("n", n).crossJoin(F.broadcast(width)).select(F.col("path").alias("source"), F.concat(F.lit("scan-"), F.lpad(F.col("n"), F.col("width"), F.lit("0")), F.lit(".png")).alias("name"))


@_query("plan_organize_kind", f"{_PATHS} SELECT path AS source, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || CASE WHEN name LIKE '%.png' THEN 'Images' WHEN name LIKE '%.zip' THEN 'Archives' WHEN name LIKE '%.rs' THEN 'Code' ELSE 'Documents' END || '/' || name AS target FROM paths WHERE NOT is_dir AND root = 3")
def _(s, d):
    bucket = {"Image": "Images", "Archive": "Archives", "Code": "Code", "Document": "Documents", "Video": "Videos", "Audio": "Audio", "Other": "Other"}
    named = F.create_map(*[F.lit(x) for kv in bucket.items() for x in kv])[names.kind(F.col("name"), F.col("is_dir"))]
    files = catalogs.with_paths(catalog(s, d)).where("not is_dir and root = 3")
    return files.select(F.col("path").alias("source"), F.concat_ws("/", F.regexp_extract("path", r"^(.*)/[^/]*$", 1), named, "name").alias("target"))


@_query("plan_collisions", f"{_CATALOG} SELECT substr(name, 7, 5) AS target, count(*) AS n FROM catalog WHERE NOT is_dir GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return catalog(s, d).where("not is_dir").groupBy(F.substring("name", 7, 5).alias("target")).agg(F.count("*").alias("n")).where("n > 1")


@_query("debounce_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600 THEN 0 ELSE 1 END AS fresh, event_id FROM events), n AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, k::BIGINT AS session, count(*) AS n FROM n GROUP BY ALL")
def _(s, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = names.seconds(F.col("ts"))
    fresh = F.when(t - F.lag(t).over(order) <= 3600, 0).otherwise(1)
    return table(s, d, "events").withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(order)).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@_query("operation_dedup", "SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL")
def _(s, d):
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))


@_query("cancel_watermark", "SELECT event_id, event_id >= max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS current FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", (F.col("event_id") >= F.max("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("current"))


@_query("url_segments", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, len(list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> ''))::BIGINT AS depth FROM pages")
def _(s, d):
    rest = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    return table(s, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.size(F.filter(F.split(rest, "/"), lambda x: x != "")).cast("long").alias("depth"))


@_query("scrub_text", """WITH t AS (SELECT conv_id, turn, string_split_regex(replace(text, '/home/user', '~'), '\\r?\\n') AS x FROM conversations),
  l AS (SELECT conv_id, turn, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS x FROM t)
  SELECT conv_id, turn, array_to_string(list_transform(x, lambda y: array_to_string(list_transform(string_split(y, ' '), lambda w: CASE WHEN regexp_matches(trim(w, '"''`(),'), '^([A-Za-z]:[\\\\/]|/[^/]*/)') THEN '<path>' ELSE w END), ' ')), chr(10)) AS text FROM l""")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", names.scrubbed(F.col("text"), "/home/user").alias("text"))


# --- dry runs and streams ---------------------------------------------------------------------------------------------------------------

_PARTS_SQL = "WITH files AS (SELECT '/parts/' || lpad(p_partkey::VARCHAR, 8, '0') || '/' || string_split(p_name, ' ')[1] || '.txt' AS path, string_split(p_name, ' ')[1] AS stem FROM part)"


def _part_files(s, d):
    stem = F.split("p_name", " ")[0]
    return table(s, d, "part").select(F.concat(F.lit("/parts/"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("/"), stem, F.lit(".txt")).alias("path"), stem.alias("stem"))


@_query("plan_transfer", f"""{_PARTS_SQL}, n AS (SELECT path, stem, row_number() OVER (PARTITION BY stem ORDER BY path) + CASE WHEN len(stem) = 5 THEN 1 ELSE 0 END AS n FROM files)
  SELECT path, '/inbox/' || stem || CASE WHEN n = 1 THEN '' ELSE ' ' || n END || '.txt' AS target FROM n""")
def _(s, d):
    files = _part_files(s, d)
    on_disk = files.where("length(stem) = 5").select(F.concat("stem", F.lit(".txt")).alias("name")).distinct()
    return mutations.transfers(files, "/inbox", on_disk)


@_query("zip_targets", f"{_PARTS_SQL} SELECT min(path) AS path, stem || '.txt' AS leaf FROM files GROUP BY stem")
def _(s, d):
    return _part_files(s, d).groupBy(mutations.leaf(F.col("path")).alias("leaf")).agg(F.min("path").alias("path"))


@_query("tag_migration", f"""{_TAGS_SQL}, ops AS (SELECT DISTINCT 'doc:' || doc_id AS path, CASE doc_id % 5 WHEN 1 THEN 'move' WHEN 2 THEN 'copy' WHEN 3 THEN 'delete' END AS op, 'new:' || doc_id AS target FROM labels WHERE doc_id % 5 IN (1, 2, 3))
  SELECT t.path, tag FROM tags t LEFT JOIN ops o ON t.path = o.path WHERE op IS NULL OR op = 'copy' UNION SELECT target, tag FROM tags t JOIN ops o ON t.path = o.path WHERE op IN ('move', 'copy')""")
def _(s, d):
    id_ = F.col("doc_id")
    op = F.when(id_ % 5 == 1, "move").when(id_ % 5 == 2, "copy").when(id_ % 5 == 3, "delete")
    ops = table(s, d, "labels").select(op.alias("op"), F.concat(F.lit("doc:"), id_).alias("source"), F.concat(F.lit("new:"), id_).alias("target")).where("op is not null").distinct()
    return mutations.migrated_tags(_tags(s, d), ops)


@_query("prefix_remap", f"{_PATHS} SELECT id, CASE WHEN path = '/EUROPE' OR starts_with(path, '/EUROPE/') THEN '/ASIA/old' || substr(path, 8) ELSE path END AS path FROM paths WHERE is_dir")
def _(s, d):
    return mutations.remapped(catalogs.with_paths(catalog(s, d)).where("is_dir").select("id", "path"), "/EUROPE", "/ASIA/old")


_SCOPES_SQL = f"{_PATHS}, scopes AS (SELECT path FROM paths WHERE is_dir AND (id % 7 = 0 OR id = 2))"


def _scopes(s, d):
    return catalogs.with_paths(catalog(s, d)).where("is_dir and (id % 7 = 0 or id = 2)").select("path")


@_query("scopes_absorbed", f"{_SCOPES_SQL} SELECT DISTINCT path FROM scopes a WHERE NOT EXISTS (SELECT 1 FROM scopes b WHERE starts_with(a.path, b.path || '/'))")
def _(s, d):
    return mutations.absorbed(_scopes(s, d))


@_query("scopes_widened", f"""{_PATHS}, wanted AS (SELECT path || CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '/gone' ELSE '/gone/too' END AS path, path AS scope FROM paths WHERE is_dir)
  SELECT path, scope FROM wanted""")
def _(s, d):
    present = catalogs.with_paths(catalog(s, d)).where("is_dir")
    wanted = present.select(F.concat("path", F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "/gone").otherwise("/gone/too")).alias("path"))
    return mutations.widened(wanted, present.select("path"))


@_query("undo_order", "SELECT -event_id AS position, CASE event_id % 4 WHEN 0 THEN 'move' WHEN 1 THEN 'delete' WHEN 2 THEN 'restore' ELSE 'delete' END AS op, CASE WHEN event_id % 4 = 2 THEN 's' ELSE 't' END || event_id AS source, CASE WHEN event_id % 4 = 0 THEN 's' || event_id END AS target FROM events")
def _(s, d):
    n = F.col("event_id")
    op = F.when(n % 4 == 0, "move").when(n % 4 == 1, "copy").when(n % 4 == 2, "delete").otherwise("create")
    source = F.when(n % 4 != 3, F.concat(F.lit("s"), n))
    return mutations.undone(table(s, d, "events").select(n.alias("position"), op.alias("op"), source.alias("source"), F.when(n % 4 != 2, F.concat(F.lit("t"), n)).alias("target")))


@_query("identity_mismatches", f"{_LEVELS_SQL} SELECT id FROM catalog a JOIN live b USING (id) WHERE a.name <> b.name OR a.size IS DISTINCT FROM b.size")
def _(s, d):
    then, now = (x.select("id", F.struct("name", "size").alias(c)) for x, c in ((catalog(s, d), "then"), (catalogs.live(_levels(s, d)), "now")))
    return then.join(now, "id").where(~F.col("then.name").eqNullSafe(F.col("now.name")) | ~F.col("then.size").eqNullSafe(F.col("now.size"))).select("id")


@_query("weekdays", "SELECT dayofweek(o_orderdate)::INT AS weekday, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy((F.dayofweek("o_orderdate") - 1).alias("weekday")).agg(F.count("*").alias("n"))


@_query("grouped_sizes", f"{_CATALOG} SELECT id, format('{{:,}}', size) AS label FROM catalog WHERE size IS NOT NULL")
def _(s, d):
    return catalog(s, d).where("size is not null").select("id", F.format_number("size", 0).alias("label"))


@_query("log_missing", "SELECT user_id, event_id AS sequence, event_id - prior - 1 AS missing FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prior FROM events) WHERE event_id - prior > 1")
def _(s, d):
    return changes.gaps(table(s, d, "events").withColumnRenamed("event_id", "sequence"), "user_id")


@_query("stream_ingest", f"{_LEVELS_SQL} SELECT id, name, size FROM live")
def _(s, d):
    """The changes above level 0 go through a stream into levels, and the catalog is read with them."""
    root = s.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stratalog-")
    root = f"{root}/stratalog/ingest-{uuid.uuid4().hex}"
    log = _levels(s, d).where("level > 0").withColumn("sequence", F.col("level").cast("long")).drop("level")
    log.write.parquet(f"{root}/log")
    stream = s.readStream.schema(log.schema).option("maxFilesPerTrigger", 64).parquet(f"{root}/log")
    changes.ingest(stream, f"{root}/levels", f"{root}/state").awaitTermination()
    return changes.current(s, catalog(s, d), f"{root}/levels").select("id", "name", "size")


# --- typed queries, lookups and labels ------------------------------------------------------------------------------------------------------

_NOW = 1785067200  # 2026-07-26, a Sunday
#: Typed words, and what each is read as: field, comparison and bounds; none for text.
_WORDS = [
    ("kind:photo", ("kind", "=", "Image", None)), ("KIND:Docs", ("kind", "=", "Document", None)), ("kind:dir", ("kind", "=", "Directory", None)), ("kind:thing", None), ("ext:.PDF", ("ext", "=", "pdf", None)),
    ("tag:Work", ("tag", "=", "work", None)), ("size:>2mb", ("size", ">", "2097152", None)), ("size:<=1.5k", ("size", "<=", "1536", None)), ("size:1mb..5MB", ("size", "range", "1048576", "5242880")), ("size:-1", None),
    ("size:2xb", None), ("size:1024", ("size", "=", "1024", None)), ("size:", None), ("modified:today", ("modified", ">=", "1785024000", None)), ("modified:yesterday", ("modified", "range", "1784937600", "1785023999")),
    ("modified:week", ("modified", ">=", "1784462400", None)), ("modified:<7d", ("modified", ">", "1784462400", None)), ("modified:>2h", ("modified", "<", "1785060000", None)), ("modified:<1y", None),
    ("modified:2026-01-01", ("modified", "range", "1767225600", "1767311999")), ("modified:>2026-01-01", ("modified", ">", "1767311999", None)), ("modified:2026-01-01..2026-02-01", ("modified", "range", "1767225600", "1769990399")),
    ("modified:2026-02-31", ("modified", "range", "1772496000", "1772582399")), ("modified:2026-13-01", None), ("report:2026", None), ("plain", None),
]


def _words_sql() -> str:
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    rows = ", ".join("(" + ", ".join(map(quoted, (w, *(f or (None,) * 4)))) + ")" for w, f in _WORDS)
    return f"SELECT * FROM (VALUES {rows}) AS t(word, field, op, low, high)"


@_query("typed_words", _words_sql())
def _(s, d):
    text = lambda x: None if x is None else str(x)
    found = [(w, grammar.filter_of(w, _NOW)) for w, _ in _WORDS]
    rows = [(w, *((f.field, f.op, text(f.low), text(f.high)) if f else (None,) * 4)) for w, f in found]
    return s.createDataFrame(rows, "word string, field string, op string, low string, high string")


@_query("typed_search", _ranked_sql("order", f"{_KIND_SQL} = 'Document' AND name LIKE '%.pdf' AND size > 1048576 AND mtime BETWEEN 852076800 AND 883612799"))
def _(s, d):
    query = grammar.parsed("order  kind:doc ext:pdf size:>1mb modified:1997-01-01..1997-12-31 kind:docs", _NOW)
    return _page(catalogs.ranked(catalog(s, d), query.text, query.where(), ascii_only=True))


@_query("typed_tags", f"{_TAGS_SQL} SELECT doc_id FROM documents WHERE 'doc:' || doc_id IN (SELECT path FROM tags WHERE lower(tag) IN ('good', 'toxic') GROUP BY path HAVING count(DISTINCT lower(tag)) = 2)")
def _(s, d):
    query = grammar.parsed("tag:Good TAG:toxic", _NOW)
    allowed = side_tables.with_all_tags(_tags(s, d), query.tags)
    return table(s, d, "documents").withColumn("path", F.concat(F.lit("doc:"), F.col("doc_id"))).join(allowed, "path", "left_semi").select("doc_id")


# --- plain words ----------------------------------------------------------------------------------------------------------------------------

#: Typed words, the text that is left of them, and field, comparison and bounds of each phrase.
_SPOKEN = [
    ("photos from last week", "", [("kind", "=", "Image", None), ("modified", "range", "1783857600", "1784462400")]), ("screenshots", "screenshots", []), ("old screenshots", "old screenshot", [("kind", "=", "Image", None)]),
    ("older than yesterday", "older than yesterday", []), ("pdfs over 20 megabytes", "", [("ext", "=", "pdf", None), ("size", ">", "20971520", None)]), ("kids under 5", "kids under 5", []),
    ("notes a couple of days ago", "notes", [("modified", "range", "1784808000", "1784980800")]), ("report since last monday", "report", [("modified", ">=", "1784505600", None)]), ("modified config", "modified config", []),
    ("in 2025", "", [("modified", "range", "1735689600", "1767225599")]), ("budget 2025", "budget 2025", []), ("zips before june 2024", "", [("kind", "=", "Archive", None), ("modified", "<", "1717200000", None)]),
    ("songs on july 31", "", [("kind", "=", "Audio", None), ("modified", "range", "1753920000", "1754006399")]), ("last weekend python files", "", [("modified", "range", "1784332800", "1784505599"), ("ext", "=", "py", None)]),
    ("tiny docs newer than 2 weeks", "", [("size", "<", "1048576", None), ("kind", "=", "Document", None), ("modified", ">", "1783857600", None)]),
]


def _values_sql(rows: list[tuple], columns: str) -> str:
    quoted = lambda x: "NULL::VARCHAR" if x is None else f"'{x}'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS t({columns})"


_NO_FILTER = [(None,) * 4]


@_query("spoken_words", _values_sql([(words, text, *f) for words, text, found in _SPOKEN for f in found or _NO_FILTER], "words, text, field, op, low, high"))
def _(s, d):
    text = lambda x: None if x is None else str(x)
    read = [(words, phrases.expand(words, _NOW)) for words, *_ in _SPOKEN]
    rows = [(words, x.text, *f) for words, x in read for f in [(f.field, f.op, text(f.low), text(f.high)) for f in x.filters] or _NO_FILTER]
    return s.createDataFrame(rows, "words string, text string, field string, op string, low string, high string")


@_query("spoken_search", _ranked_sql("order", "name LIKE '%.pdf' AND size > 10485760 AND mtime BETWEEN 852076800 AND 883612799"))
def _(s, d):
    query = phrases.searched("order pdfs over 10 megabytes from 1997", _NOW)
    return _page(catalogs.ranked(catalog(s, d), query.text, query.where(), ascii_only=True))


#: Sentences with their verb, what they act on (text, filters, folder) and what with.
_SENTENCES = [
    ("move pdfs from Downloads to Documents", "move", "", "ext", "Downloads", "Documents"), ("delete screenshots", "delete", "screenshot", "kind", None, None), ("remove tag Work from invoices", "untag", "invoices", "", None, "Work"),
    ("copy big videos in my Movies folder into the Backup folder", "copy", "", "size,kind", "Movies", "Backup"), ("move report to a new folder called Trip", "move", "report", "", None, "Trip"),
    ("organize Downloads by type", "organize", "", "", "Downloads", "kind"), ("tag notes with blue very urgent", "tag", "notes", "", None, "very urgent"), ("zip photos from last week", "compress", "", "kind,modified", None, None),
    ("how many pdfs are there?", "count", "", "ext", None, None), ("how big is Downloads", "size", "Downloads", "", None, None), ("largest 10 videos", "largest", "", "kind", None, "10"), ("delete", None, None, None, None, None),
    ("go to the Downloads folder in a new tab", "go", None, None, None, "Downloads"), ("quarterly report", None, None, None, None, None),
]


@_query("spoken_sentences", _values_sql(_SENTENCES, "sentence, verb, text, fields, folder, other"))
def _(s, d):
    def row(sentence: str) -> tuple:
        match found := commands.interpreted(sentence, _NOW):
            case None:
                return (sentence, *(None,) * 5)
            case commands.Go(name):
                return sentence, "go", None, None, None, name
            case commands.Question():
                verb, other = found.asks, found.top
            case commands.Command():
                verb, other = found.verb, getattr(found.to, "name", found.to)
        of = found.of
        return sentence, verb, of.text, ",".join(f.field for f in of.filters), of.within and of.within.name, None if other is None else str(other)

    return s.createDataFrame([row(sentence) for sentence, *_ in _SENTENCES], "sentence string, verb string, text string, fields string, folder string, other string")


def _answer(s, d, sentence: str, shown: str = "/") -> DataFrame:
    return sentences.answered(commands.interpreted(sentence, _NOW), catalogs.with_paths(catalog(s, d)), shown)


@_query("spoken_count", f"{_PATHS} SELECT count(*) AS n FROM paths WHERE starts_with(path, '/ASIA/') AND name LIKE '%.pdf' AND NOT is_dir")
def _(s, d):
    return _answer(s, d, "how many pdfs in asia")


@_query("spoken_size", f"{_PATHS} SELECT count(*) AS n, sum(size)::BIGINT AS bytes FROM paths WHERE starts_with(path, '/EUROPE/NATION_3/') AND NOT is_dir")
def _(s, d):
    return _answer(s, d, "how big is nation_3?", "/EUROPE")


@_query("spoken_largest", f"{_PATHS} SELECT id, path, size FROM paths WHERE (name LIKE '%.pdf' OR name LIKE '%.txt') AND NOT is_dir AND size IS NOT NULL AND mtime >= 852076800 ORDER BY size DESC, id LIMIT 20")
def _(s, d):
    return _answer(s, d, "largest 20 documents since 1997")


_WORDS_OF_SQL = "list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: w <> '')"


@_query("ranked_search_fuzzy", f"""{_CATALOG}, hits AS (SELECT id, name FROM catalog WHERE parent <> 0 AND len(list_filter({_WORDS_OF_SQL}, lambda w: levenshtein(w, 'natin') <= 1)) > 0)
  SELECT row_number() OVER (ORDER BY strlen(name), lower(name), id) AS rank, id, name, 4::INT AS tier FROM hits""")
def _(s, d):
    return _page(catalogs.ranked(catalog(s, d), "natin", ascii_only=True, fuzzy=True))


@_query("fuzzy_words", f"SELECT DISTINCT p_name AS name FROM (SELECT p_name, lower(p_name) AS name FROM part) WHERE len(list_filter({_WORDS_OF_SQL}, lambda w: len(w) BETWEEN 3 AND 24 AND levenshtein(w, 'bol') <= 1)) > 0")
def _(s, d):
    return table(s, d, "part").select(F.col("p_name").alias("name")).distinct().where(names.resembles(F.col("name"), "bol", True))


@_query("record_by_id", f"{_CATALOG} SELECT * FROM catalog WHERE id = 1000000007")
def _(s, d):
    return catalog(s, d).where("id = 1000000007")


@_query("root_records", f"{_CATALOG} SELECT root, id, name FROM catalog WHERE parent = 0")
def _(s, d):
    return catalog(s, d).where("parent = 0").select("root", "id", "name")


@_query("resolved_paths", f"{_PATHS} SELECT path, id FROM paths WHERE path IN ('/ASIA', '/ASIA/NATION_2', '/EUROPE/NATION_3', '/EUROPE/nowhere')")
def _(s, d):
    wanted = s.createDataFrame([(x,) for x in ("/ASIA", "/ASIA/NATION_2", "/EUROPE/NATION_3", "/EUROPE/nowhere")], "path string")
    return catalogs.with_paths(catalog(s, d)).join(F.broadcast(wanted), "path").select("path", "id")


@_query("new_folders", f"{_PATHS} SELECT path FROM paths WHERE is_dir AND NOT starts_with(path, '/ASIA') GROUP BY path")
def _(s, d):
    folders = catalogs.with_paths(catalog(s, d)).where("is_dir").select("path")
    return folders.distinct().join(folders.where(F.startswith("path", F.lit("/ASIA"))), "path", "left_anti")


@_query("extension_labels", f"{_CATALOG} SELECT upper(regexp_extract(name, '\\.([^.]*)$', 1))[:4] AS label, count(*) AS n FROM catalog WHERE NOT is_dir GROUP BY 1")
def _(s, d):
    return catalog(s, d).where("not is_dir").groupBy(names.extension_label(F.col("name")).alias("label")).agg(F.count("*").alias("n"))


_SEEN = 1706572800  # 2024-01-30


@_query("modified_labels", f"""WITH t AS (SELECT event_id, floor(epoch(ts))::BIGINT AS t FROM events), x AS (SELECT *, make_timestamp(t * 1000000) AS moment, {_SEEN // 86400} - floor(t / 86400)::BIGINT AS days FROM t)
  SELECT event_id, CASE WHEN {_SEEN} - t < 60 THEN 'Just now' WHEN days = 0 THEN strftime(moment, 'Today at %-I:%M %p') WHEN days = 1 THEN 'Yesterday' WHEN days < 7 THEN strftime(moment, '%A') WHEN year(moment) = 2024 THEN strftime(moment, '%b %-d') ELSE strftime(moment, '%b %-d, %Y') END AS label FROM x""")
def _(s, d):
    return table(s, d, "events").select("event_id", names.format_modified(F.floor(names.seconds(F.col("ts"))), _SEEN).alias("label"))


@_query("timestamp_labels", "SELECT event_id, strftime(ts, '%b %-d, %Y at %-I:%M %p') AS label FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", names.format_timestamp(F.floor(names.seconds(F.col("ts")))).alias("label"))


def _organized(by: str, sql: str):
    @_query(f"organize_by_{by}", f"{_CATALOG} SELECT {sql} AS bucket, count(*) AS n FROM catalog WHERE NOT is_dir GROUP BY 1")
    def _(s, d):
        return catalog(s, d).where("not is_dir").groupBy(names.bucket(F.col("name"), F.col("mtime"), by).alias("bucket")).agg(F.count("*").alias("n"))


_organized("extension", "upper(regexp_extract(name, '\\.([^.]*)$', 1))")
_organized("month", "strftime(make_timestamp(mtime * 1000000), '%Y-%m')")
_organized("year", "strftime(make_timestamp(mtime * 1000000), '%Y')")


@_query("valid_file_names", "SELECT page_id, x <> '' AND NOT regexp_matches(x, '[/\\\\]') AND x NOT IN ('.', '..') AS valid FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS x FROM pages)")
def _(s, d):
    return table(s, d, "pages").select("page_id", names.valid_file_name(F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")).alias("valid"))


@_query("percent_codes", "SELECT conv_id, turn, url_encode(text) AS code, text AS back FROM conversations")
def _(s, d):
    code = addresses.percent_encode(F.col("text"))
    return table(s, d, "conversations").select("conv_id", "turn", code.alias("code"), addresses.percent_decode(code).alias("back"))


@_query("page_codes", "SELECT page_id, url_encode(html) AS code, html AS back FROM pages")
def _(s, d):
    code = addresses.percent_encode(F.col("html"))
    return table(s, d, "pages").select("page_id", code.alias("code"), addresses.percent_decode(code).alias("back"))


_MOUNTED_SQL = """WITH t AS (SELECT c_custkey AS line, c_nationkey AS machine, c_custkey % 4 AS k, c_custkey % 3 AS disk, c_mktsegment AS m FROM customer),
  kept AS (SELECT *, row_number() OVER (PARTITION BY machine, m ORDER BY line) AS place FROM t WHERE k <> 0)"""


def _mount_lines(s, d):
    k, disk, m = F.col("c_custkey") % 4, (F.col("c_custkey") % 3).cast("string"), F.col("c_mktsegment")
    source = F.when(k == 0, "proc").when(k == 1, F.concat(F.lit("/dev/sd"), disk)).when(k == 2, F.concat(F.lit("//me@nas/disk\\040"), disk)).otherwise(F.concat(F.lit("srv:/export/"), disk))
    kind = F.when(k == 0, "proc").when(k == 1, "ext4").when(k == 2, "cifs").otherwise("nfs4")
    text = F.concat_ws(" ", source, F.concat(F.lit("/media/a\\040"), m, F.lit("\\134")), kind, F.lit("rw 0 0"))
    return table(s, d, "customer").select(F.col("c_nationkey").alias("machine"), F.col("c_custkey").alias("line"), text.alias("text"))


@_query("mount_table", f"""{_MOUNTED_SQL} SELECT machine, line, '/media/a ' || m || '\\' AS mount,
  CASE k WHEN 1 THEN '/dev/sd' || disk WHEN 2 THEN '//me@nas/disk ' || disk ELSE 'srv:/export/' || disk END AS source, CASE k WHEN 1 THEN 'ext4' WHEN 2 THEN 'cifs' ELSE 'nfs4' END AS type
  FROM kept WHERE place = 1""")
def _(s, d):
    return addresses.mounts(_mount_lines(s, d), ("machine",))


@_query("mounted_shares", f"""{_MOUNTED_SQL} SELECT machine, line, CASE k WHEN 2 THEN 'smb' ELSE 'nfs' END AS protocol, CASE k WHEN 2 THEN 'nas' ELSE 'srv' END AS host,
  CASE k WHEN 2 THEN 'me' END AS "user", CASE k WHEN 2 THEN 'disk ' || disk ELSE 'export/' || disk END AS below FROM kept WHERE place = 1 AND k <> 1""")
def _(s, d):
    found = addresses.mounts(_mount_lines(s, d), ("machine",)).withColumn("a", addresses.mounted_share(F.col("source"), F.col("type"))).where("a is not null")
    return found.select("machine", "line", "a.protocol", "a.host", "a.user", F.array_join("a.segments", "/").alias("below"))


@_query("share_addresses", """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, CASE WHEN page_id % 2 = 0 THEN 'ann b' END AS "user",
  array_to_string(list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> ''), '|') AS segments FROM pages
  WHERE len(list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> '')) > 0 AND NOT contains(url, '%') AND NOT regexp_matches(url, '^[a-z]+://[^/]*@')""")
def _(s, d):
    user = F.when(F.col("page_id") % 2 == 0, "ann%20b@").otherwise("@")
    text = F.concat(F.lit(" SMB://"), user, F.regexp_replace("url", "^[a-z]+://", ""))
    pages = table(s, d, "pages").where("not contains(url, '%') and not url rlike '^[a-z]+://[^/]*@'").withColumn("a", addresses.share(text)).where("a is not null")
    return pages.select("page_id", "a.host", "a.user", F.array_join("a.segments", "|").alias("segments"))


@_query("rename_by_pattern", f"""{_PATHS} SELECT path AS source, regexp_replace(name, '\\.[^.]*$', '') || '-' || lpad(row_number() OVER (PARTITION BY parent ORDER BY path)::VARCHAR,
  len((count(*) OVER (PARTITION BY parent))::VARCHAR)::INT, '0') || '.' || regexp_extract(name, '\\.([^.]*)$', 1) AS name FROM paths WHERE NOT is_dir AND starts_with(path, '/EUROPE/')""")
def _(s, d):
    pattern = patterns.parsed("{name}-{ N }.{ext}")
    files = catalogs.with_paths(catalog(s, d)).where(names.path_under(F.col("path"), "/EUROPE") & ~F.col("is_dir"))
    folder = Window.partitionBy("parent")
    numbered = files.select("path", "name", F.row_number().over(folder.orderBy("path")).alias("n"), F.length(F.count("*").over(folder).cast("string")).alias("width"))
    return numbered.select(F.col("path").alias("source"), pattern.render(F.col("name"), F.col("n"), F.col("width")).alias("name"))


_VOCABULARY = ("bolt", "blot", "widget", "gizmo", "gear", "ring", "small", "large", "green", "blue")


@_query("nearest_words", f"""WITH words AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part), typed AS (SELECT w[2] || w[1] || w[3:] AS word FROM words),
  far AS (SELECT word, v, damerau_levenshtein(word, v) AS d, v[1] = word[1] AS same FROM typed, (SELECT unnest({list(_VOCABULARY)}) AS v)),
  least AS (SELECT *, min(d) OVER (PARTITION BY word) AS least FROM far),
  close AS (SELECT word, count(*) AS n, min(v) AS v, count(*) FILTER (same) AS n_same, min(v) FILTER (same) AS v_same FROM least
    WHERE d = least AND d > 0 AND d <= CASE WHEN len(word) >= 8 THEN 2 ELSE 1 END GROUP BY word)
  SELECT t.word, CASE WHEN n = 1 THEN v WHEN n_same = 1 THEN v_same END AS nearest FROM typed t LEFT JOIN close c ON t.word = c.word""")
def _(s, d):
    words = table(s, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct()
    typed = words.select(F.concat(F.substring("w", 2, 1), F.substring("w", 1, 1), F.substr("w", F.lit(3))).alias("word"))
    return typed.withColumn("nearest", names.nearest_of(list(_VOCABULARY))("word"))


@_query("folders_like", f"""{_CATALOG}, x AS (SELECT DISTINCT name, damerau_levenshtein(lower(name), 'natoin_1') AS distance FROM catalog WHERE is_dir)
  SELECT distance::INT AS distance, name FROM x WHERE distance <= 2 ORDER BY distance, name LIMIT 3""")
def _(s, d):
    return catalogs.folders_like(catalog(s, d).where("is_dir"), "natoin_1")


_TAG_SETS_SQL = "SELECT doc_id, array_to_string(list_concat(list_filter([CASE quality WHEN 1 THEN 'Good' ELSE 'Low' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), ['New:Red']), ',') AS tags FROM labels"


def _tag_sets(s, d):
    tag = lambda name: F.struct(name.alias("name"), F.lit(None).cast("string").alias("color"))
    named = F.array(F.when(F.col("quality") == 1, "Good").otherwise("Low"), F.when(F.col("toxic") == 1, "toxic"))
    return table(s, d, "labels").select("doc_id", F.transform(F.filter(named, lambda n: n.isNotNull()), tag).alias("tags"))


def _tags_shown(tags):
    return F.array_join(F.transform(tags, lambda t: F.concat_ws(":", t["name"], t["color"])), ",")


@_query("tags_added", _TAG_SETS_SQL)
def _(s, d):
    new = side_tables.system_tag(F.lit("New\n6"))
    return _tag_sets(s, d).select("doc_id", _tags_shown(side_tables.with_tag(F.col("tags"), new)).alias("tags"))


@_query("tags_replaced", "SELECT doc_id, 'toxic:Grey' AS tags FROM labels WHERE quality = 0")
def _(s, d):
    new = side_tables.system_tag(F.lit("toxic\n1"))
    low = _tag_sets(s, d).join(table(s, d, "labels").where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    return low.select("doc_id", _tags_shown(side_tables.with_tag(F.col("tags"), new, F.lit("Low"))).alias("tags"))


@_query("tags_removed", "SELECT doc_id, CASE WHEN quality = 1 THEN 'Good' ELSE 'Low' END AS tags FROM labels")
def _(s, d):
    return _tag_sets(s, d).select("doc_id", _tags_shown(side_tables.without_tag(F.col("tags"), F.lit("TOXIC"))).alias("tags"))


@_query("retry_delays", "SELECT event_id, least(30 * pow(2, event_id % 40), 900)::BIGINT AS delay FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", changes.retry_delay(F.col("event_id") % 40 + 1).alias("delay"))


@_query("indexed_records", f"""{_PATHS} SELECT id, path FROM paths WHERE NOT starts_with(path || '/', '/ASIA/') AND NOT starts_with(path || '/', '/EUROPE/NATION_3/')
  AND NOT contains(path || CASE WHEN is_dir THEN '/' ELSE '' END, '/NATION_1/')""")
def _(s, d):
    left_out = areas.excluded(F.col("path"), F.col("is_dir"), "/", ("NATION_1", "order_00000002.png"), ("/EUROPE/NATION_3", "/"), ("asia",))
    return catalogs.with_paths(catalog(s, d)).where(~left_out).select("id", "path")


@_query("new_roots", f"""{_PATHS} SELECT path, starts_with(path || '/', '/EUROPE/') OR starts_with(path || '/', '/ASIA/NATION_2/') OR starts_with('/ASIA/NATION_2/', path || '/') AS overlaps
  FROM paths WHERE is_dir""")
def _(s, d):
    folders = catalogs.with_paths(catalog(s, d)).where("is_dir")
    return folders.select("path", areas.overlaps(F.col("path"), ["/EUROPE", "/ASIA/NATION_2/"]).alias("overlaps"))


@_query("bookmarked_paths", "SELECT '/a b/' || page_id % 10 AS path, min(page_id) AS line FROM pages WHERE page_id % 3 = 0 GROUP BY 1")
def _(s, d):
    k, n = F.col("page_id") % 3, (F.col("page_id") % 10).cast("string")
    text = F.when(k == 0, F.concat(F.lit("file:///a%20b/"), n, F.lit(" A label"))).when(k == 1, F.concat(F.lit("sftp://host/"), n)).otherwise("file:///c%zz")
    return addresses.bookmarks(table(s, d, "pages").select(F.col("page_id").alias("line"), text.alias("text")))


@_query("described_records", f"""{_CATALOG} SELECT CASE WHEN is_dir THEN 'Folder' WHEN name LIKE '%.pdf' THEN 'PDF Document' WHEN name LIKE '%.png' THEN 'PNG Image' WHEN name LIKE '%.txt' THEN 'Plain Text'
  WHEN name LIKE '%.zip' THEN 'ZIP Archive' WHEN name LIKE '%.rs' THEN 'Rust Source' END AS described, count(*) AS n FROM catalog GROUP BY 1""")
def _(s, d):
    return catalog(s, d).groupBy(names.described(F.col("name"), F.col("is_dir")).alias("described")).agg(F.count("*").alias("n"))


@_query("last_days", """WITH x AS (SELECT event_id, ts::DATE AS day FROM events), y AS (SELECT *, dayofweek(day) AS w FROM x)
  SELECT event_id, (epoch(day - CASE WHEN w = 2 THEN 7 ELSE (w + 5) % 7 END::INT) // 86400)::BIGINT AS last_tuesday,
  (epoch(day - CASE WHEN w = 0 THEN 8 ELSE w + 1 END::INT) // 86400)::BIGINT AS last_weekend FROM y""")
def _(s, d):
    day = names.day(F.floor(names.seconds(F.col("ts"))))
    return table(s, d, "events").select("event_id", names.previous_weekday(day, 2).cast("long").alias("last_tuesday"), names.last_weekend(day).cast("long").alias("last_weekend"))


@_query("used_fractions", "SELECT p_partkey, CASE WHEN total > 0 THEN greatest(total - free, 0) / total ELSE 0 END::FLOAT AS used FROM (SELECT p_partkey, CASE WHEN p_size > 3 THEN p_size * 100 - 400 END AS total, p_retailprice AS free FROM part)")
def _(s, d):
    total = F.when(F.col("p_size") > 3, F.col("p_size") * 100 - 400)
    return table(s, d, "part").select("p_partkey", names.used_fraction(total, F.col("p_retailprice")).alias("used"))


_RENAMED_SQL = f"""{_PATHS}, f AS (SELECT path, name, row_number() OVER (ORDER BY path) AS n, count(*) OVER () AS total FROM paths WHERE is_dir AND parent IN (SELECT id FROM catalog WHERE parent = 0))"""


def _renamed(s, d):
    """The folders right below the roots."""
    records = catalogs.with_paths(catalog(s, d))
    roots = records.where("parent = 0").select(F.col("id").alias("parent"))
    return mutations.renamed(records.where("is_dir").join(roots, "parent", "left_semi"), patterns.parsed("{n} {name}"))


@_query("plan_rename_batch", f"{_RENAMED_SQL} SELECT path AS source, lpad(n::VARCHAR, len(total::VARCHAR)::INT, '0') || ' ' || name AS name, false AS unchanged FROM f")
def _(s, d):
    return _renamed(s, d)


@_query("plan_totals", f"{_RENAMED_SQL} SELECT count(*) AS operations, 0::BIGINT AS skipped FROM f")
def _(s, d):
    return _renamed(s, d).agg(F.count_if(~F.col("unchanged")).alias("operations"), F.count_if("unchanged").alias("skipped"))
