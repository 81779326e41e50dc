"""Catalog views over the star-schema tables, as DataFrames, with the same views as DuckDB table expressions.

Ids of the order tree: 1 root, 1000 + region, 10000 + nation, 1000000 + customer, 1000000000 + order.
Fixed values: reason bits of the journal are those of the public change-journal record format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
DATA_OVERWRITE, DATA_EXTEND, DATA_TRUNCATION, FILE_CREATE, FILE_DELETE = 0x1, 0x2, 0x4, 0x100, 0x200
RENAME_OLD, RENAME_NEW, BASIC_INFO, HARD_LINK, COMPRESSION, ENCRYPTION = 0x1000, 0x2000, 0x8000, 0x10000, 0x20000, 0x40000
DIRECTORY, DELETED, SOURCE_ROOT, HIDDEN, SYSTEM, READ_ONLY = 1, 2, 4, 8, 16, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat catalog of one source: id, name, ext, folder, path, size, source_key."""
    ext = F.lower("p_type")
    name = F.concat("p_name", F.lit("."), ext)
    size = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), ext.alias("ext"), F.col("p_brand").alias("folder"), F.concat(F.lit("P:/"), "p_brand", F.lit("/"), name).alias("path"), (size * size * 65536).alias("size"), F.lit("P").alias("source_key"))


def _node(df: DataFrame, id_: Column, parent: Column, name: Column, is_dir: bool, size: Column, modified: Column) -> DataFrame:
    return df.select(id_.cast("long").alias("id"), parent.cast("long").alias("parent_id"), name.alias("name"), F.lit(is_dir).alias("is_dir"), size.cast("long").alias("size"), modified.cast("timestamp").alias("modified"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacency rows of region / nation / customer / order below one root."""
    none, no_time = F.lit(0), F.lit(None).cast("timestamp")
    root = spark.range(1).select(F.lit(1).cast("long").alias("id"), F.lit(1).cast("long").alias("parent_id"), F.lit("").alias("name"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), no_time.alias("modified"))
    region = _node(table(spark, sf_dir, "region"), 1000 + F.col("r_regionkey"), F.lit(1), F.col("r_name"), True, none, no_time)
    nation = _node(table(spark, sf_dir, "nation"), 10000 + F.col("n_nationkey"), 1000 + F.col("n_regionkey"), F.col("n_name"), True, none, no_time)
    customer = _node(table(spark, sf_dir, "customer"), 1000000 + F.col("c_custkey"), 10000 + F.col("c_nationkey"), F.col("c_name"), True, none, no_time)
    leaf = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit("."), F.lower("o_orderstatus"))
    orders = _node(table(spark, sf_dir, "orders"), 1000000000 + F.col("o_orderkey"), 1000000 + F.col("o_custkey"), leaf, False, F.floor("o_totalprice"), F.col("o_orderdate"))
    return root.unionByName(region).unionByName(nation).unionByName(customer).unionByName(orders)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with path, depth, parent_path and ancestor ids and names, materialised by joins of known depth: each
    level joins the one above, so an order is joined to its customer once and to nothing else."""
    t = {k: table(spark, sf_dir, k) for k in ("region", "nation", "customer", "orders")}
    no_time = F.lit(None).cast("timestamp")

    def level(df: DataFrame, id_: Column, parent: Column, name: Column, depth: int, is_dir: bool, size: Column, modified: Column) -> DataFrame:
        up = F.col("up_path") if depth > 1 else F.lit("T:")
        names = F.concat("up_names", F.array(name)) if depth > 1 else F.array(name)
        ids = F.concat("up_ids", F.array(parent.cast("long"))) if depth > 1 else F.array(F.lit(1).cast("long"))
        return df.select(id_.cast("long").alias("id"), parent.cast("long").alias("parent_id"), name.alias("name"), F.lit(is_dir).alias("is_dir"), size.cast("long").alias("size"), modified.cast("timestamp").alias("modified"), F.lit(depth).alias("depth"), F.concat(up, F.lit("/"), name).alias("path"), up.alias("parent_path"), ids.alias("ancestors"), names.alias("names"))

    def above(df: DataFrame) -> DataFrame:
        return df.select(F.col("id").alias("up_id"), F.col("path").alias("up_path"), F.col("names").alias("up_names"), F.col("ancestors").alias("up_ids"))

    region = level(t["region"], 1000 + F.col("r_regionkey"), F.lit(1), F.col("r_name"), 1, True, F.lit(0), no_time)
    nation = t["nation"].withColumn("k", (1000 + F.col("n_regionkey")).cast("long")).join(above(region), F.col("k") == F.col("up_id"))
    nation = level(nation, 10000 + F.col("n_nationkey"), F.col("k"), F.col("n_name"), 2, True, F.lit(0), no_time)
    customer = t["customer"].withColumn("k", (10000 + F.col("c_nationkey")).cast("long")).join(above(nation), F.col("k") == F.col("up_id"))
    customer = level(customer, 1000000 + F.col("c_custkey"), F.col("k"), F.col("c_name"), 3, True, F.lit(0), no_time)
    leaf = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit("."), F.lower("o_orderstatus"))
    orders = t["orders"].withColumn("k", (1000000 + F.col("o_custkey")).cast("long")).join(above(customer), F.col("k") == F.col("up_id"))
    orders = level(orders, 1000000000 + F.col("o_orderkey"), F.col("k"), leaf, 4, False, F.floor("o_totalprice"), F.col("o_orderdate"))
    return region.unionByName(nation).unionByName(customer).unionByName(orders)


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, host, path (host and segments without query, fragment and last slash), name (last segment)."""
    rest = F.regexp_extract("url", r"://([^?#]+)", 1)
    path = F.regexp_replace(rest, "/+$", "")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), path.alias("path"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records from events: usn, ts, id, reason, size."""
    kind = F.col("event_type")
    reason = F.when(kind == "signup", FILE_CREATE).when(kind == "click", DATA_EXTEND).when(kind == "view", BASIC_INFO).when(kind == "purchase", RENAME_NEW).when(kind == "error", FILE_DELETE).otherwise(0)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("usn"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("id"), reason.alias("reason"), F.floor(F.col("value") * 100).cast("long").alias("size"))


#: DuckDB texts of the same views.
CTE = {
    "parts": "SELECT p_partkey AS id, p_name || '.' || lower(p_type) AS name, lower(p_type) AS ext, p_brand AS folder, 'P:/' || p_brand || '/' || p_name || '.' || lower(p_type) AS path, CAST(p_size AS BIGINT) * p_size * 65536 AS size, 'P' AS source_key FROM part",
    "tree": """SELECT CAST(1 AS BIGINT) AS id, CAST(1 AS BIGINT) AS parent_id, '' AS name, true AS is_dir, CAST(0 AS BIGINT) AS size, CAST(NULL AS TIMESTAMP) AS modified
 UNION ALL SELECT 1000 + r_regionkey, 1, r_name, true, 0, NULL FROM region
 UNION ALL SELECT 10000 + n_nationkey, 1000 + n_regionkey, n_name, true, 0, NULL FROM nation
 UNION ALL SELECT 1000000 + c_custkey, 10000 + c_nationkey, c_name, true, 0, NULL FROM customer
 UNION ALL SELECT 1000000000 + o_orderkey, 1000000 + o_custkey, 'order-' || o_orderkey || '.' || lower(o_orderstatus), false, CAST(floor(o_totalprice) AS BIGINT), o_orderdate FROM orders""",
    "paths": """WITH RECURSIVE t AS (SELECT CAST(1 AS BIGINT) AS id, CAST(1 AS BIGINT) AS parent_id, '' AS name, true AS is_dir, CAST(0 AS BIGINT) AS size, CAST(NULL AS TIMESTAMP) AS modified
 UNION ALL SELECT 1000 + r_regionkey, 1, r_name, true, 0, NULL FROM region
 UNION ALL SELECT 10000 + n_nationkey, 1000 + n_regionkey, n_name, true, 0, NULL FROM nation
 UNION ALL SELECT 1000000 + c_custkey, 10000 + c_nationkey, c_name, true, 0, NULL FROM customer
 UNION ALL SELECT 1000000000 + o_orderkey, 1000000 + o_custkey, 'order-' || o_orderkey || '.' || lower(o_orderstatus), false, CAST(floor(o_totalprice) AS BIGINT), o_orderdate FROM orders),
 r AS (SELECT id, parent_id, name, is_dir, size, modified, 1 AS depth, 'T:/' || name AS path, 'T:' AS parent_path, [CAST(1 AS BIGINT)] AS ancestors, [name] AS names FROM t WHERE parent_id = 1 AND id <> 1
 UNION ALL SELECT t.id, t.parent_id, t.name, t.is_dir, t.size, t.modified, r.depth + 1, r.path || '/' || t.name, r.path, list_append(r.ancestors, t.parent_id), list_append(r.names, t.name) FROM t JOIN r ON t.parent_id = r.id)
 SELECT * FROM r""",
    "page_paths": "SELECT page_id, url, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_replace(regexp_extract(url, '://([^?#]+)', 1), '/+$', '') AS path, regexp_extract(regexp_replace(regexp_extract(url, '://([^?#]+)', 1), '/+$', ''), '([^/]*)$', 1) AS name FROM pages",
    "journal": f"SELECT event_id AS usn, CAST(ts AS TIMESTAMP) AS ts, user_id AS id, CASE event_type WHEN 'signup' THEN {FILE_CREATE} WHEN 'click' THEN {DATA_EXTEND} WHEN 'view' THEN {BASIC_INFO} WHEN 'purchase' THEN {RENAME_NEW} WHEN 'error' THEN {FILE_DELETE} ELSE 0 END AS reason, CAST(floor(value * 100) AS BIGINT) AS size FROM events",
}
VIEWS = {"parts": parts, "tree": tree, "paths": paths, "page_paths": page_paths, "journal": journal}
