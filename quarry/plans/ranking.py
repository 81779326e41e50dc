"""Queries of orders, merges, tokens, history and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import instant as I
from quarry.operators import joins as J
from quarry.operators import ranking as R
from quarry.operators import search as N
from quarry.plans.registry import query
from quarry.sources import catalog

@query("SELECT id, name, 'P' AS source FROM parts UNION ALL SELECT page_id AS id, path AS name, host AS source FROM page_paths")
def union_sources(spark, sf_dir):
    pages = catalog.page_paths(spark, sf_dir).select(F.col("page_id").alias("id"), F.col("path").alias("name"), F.col("host").alias("source"))
    return catalog.parts(spark, sf_dir).select("id", "name", F.lit("P").alias("source")).unionByName(pages)


@query("SELECT DISTINCT id FROM parts WHERE id NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def set_except(spark, sf_dir):
    """Ids of one set that another lacks: parts that no event names."""
    used = catalog.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return catalog.parts(spark, sf_dir).select("id").subtract(used)


@query("SELECT id, path FROM parts WHERE id % 3 = 0 UNION ALL SELECT id, path FROM parts WHERE id % 3 <> 1 AND lower(path) NOT IN (SELECT lower(path) FROM parts WHERE id % 3 = 0) UNION ALL SELECT id, path FROM parts WHERE id % 3 = 1 AND lower(path) NOT IN (SELECT lower(path) FROM parts WHERE id % 3 = 0)")
def merge_local_global(spark, sf_dir):
    rows = catalog.parts(spark, sf_dir).select("id", "path")
    return R.merged(rows.where("id % 3 = 0"), rows)


@query("SELECT id, name, modified FROM paths WHERE NOT is_dir AND modified >= TIMESTAMP '2001-01-01 00:00:00' ORDER BY modified DESC, id LIMIT 100")
def recent_files(spark, sf_dir):
    """The newest files since a time."""
    files = catalog.tree(spark, sf_dir).where(~F.col("is_dir") & (F.col("modified") >= F.lit("2001-01-01 00:00:00").cast("timestamp")))
    return files.select("id", "name", "modified").orderBy(F.desc("modified"), "id").limit(100)


@query("""SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h' || CASE WHEN s // 60 % 60 > 0 THEN ' ' || (s // 60 % 60) || 'm' ELSE '' END || ' ago'
 ELSE (s // 86400) || 'd' || CASE WHEN s // 3600 % 24 > 0 THEN ' ' || (s // 3600 % 24) || 'h' ELSE '' END || ' ago' END AS label FROM (SELECT o_orderkey, o_orderkey * o_orderkey % 400000 AS s FROM orders)""")
def column_age(spark, sf_dir):
    key = F.col("o_orderkey")
    return catalog.table(spark, sf_dir, "orders").select("o_orderkey", I.age_label(key * key % 400000).alias("label"))



@query("""WITH h AS (SELECT user_id, max(event_id) AS last_at FROM events GROUP BY user_id),
x AS (SELECT p.id AS id, p.path AS path, coalesce(-h.last_at, 9223372036854775807) AS priority, p.id % 11 AS pos, p.source_key AS source_key FROM parts p LEFT JOIN h ON p.id = h.user_id)
SELECT CAST(row_number() OVER (ORDER BY priority, pos, length(path), lower(source_key), lower(path), id) AS BIGINT) AS place, id, priority FROM x""")
def order_results(spark, sf_dir):
    """Cross-source order: most recent in history first, then rank, path length, drive, path."""
    latest = catalog.table(spark, sf_dir, "events").where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("last_at"))
    rows = catalog.parts(spark, sf_dir).join(latest, "id", "left").withColumns({"priority": F.coalesce(-F.col("last_at"), F.lit(9223372036854775807)), "pos": F.col("id") % 11})
    order = ["priority", "pos", F.length("path"), F.lower("source_key"), F.lower("path"), "id"]
    return R.numbered(rows, *order).select("place", "id", "priority")


@query("SELECT p_partkey AS id, coalesce((SELECT max(event_id) FROM events WHERE user_id = p_partkey), 9223372036854775807) AS last_at FROM part")
def join_history(spark, sf_dir):
    used = catalog.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"))
    return J.last_used(catalog.parts(spark, sf_dir).select("id"), used)


@query("""SELECT id, path, weight FROM (SELECT id, path, weight, row_number() OVER (PARTITION BY lower(path) ORDER BY curated DESC, priority, type_rank, weight DESC, length(path), path, id) AS rn
FROM (SELECT id, path, id % 10 = 0 AS curated, id % 5 AS priority, id % 3 AS type_rank, (id % 100) / 100.0::DOUBLE AS weight FROM parts)) WHERE rn = 1""")
def order_curated(spark, sf_dir):
    rows = catalog.parts(spark, sf_dir).select("id", "path", (F.col("id") % 10 == 0).alias("curated"), (F.col("id") % 5).alias("priority"), (F.col("id") % 3).alias("type_rank"), ((F.col("id") % 100) / 100.0).alias("weight"))
    return R.curated_order(rows).select("id", "path", "weight")


@query("""WITH x AS (SELECT id, path, (id % 100) / 100.0::DOUBLE AS weight, id % 3 AS type_rank FROM parts WHERE starts_with(lower(path), 'p:/brand#2/') AND contains(lower(name), 'bolt')),
 h AS (SELECT lower(p.path) AS k, max(event_id) AS last_at FROM events JOIN parts p ON p.id = user_id GROUP BY 1),
 y AS (SELECT x.*, h.last_at IS NOT NULL OR f.k IS NOT NULL AS curated, coalesce(-h.last_at, 9223372036854775807) AS priority FROM x LEFT JOIN h ON h.k = lower(x.path) LEFT JOIN (SELECT DISTINCT lower(path) AS k FROM parts WHERE id % 10 = 0) f ON f.k = lower(x.path)),
 z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY curated DESC, priority, type_rank, weight DESC, length(path), path, id) = 1)
SELECT row_number() OVER (ORDER BY curated DESC, priority, type_rank, weight DESC, length(path), path, id) AS place, id, path, curated FROM z""")
def scoped_results(spark, sf_dir):
    rows = catalog.parts(spark, sf_dir).withColumns({"weight": (F.col("id") % 100) / 100.0, "type_rank": F.col("id") % 3})
    used = catalog.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("last_at")).join(rows.select("id", "path"), "id")
    return R.scoped(rows, "P:/Brand#2", "'bolt", rows.where("id % 10 = 0").select("path"), used).select("place", "id", "path", "curated")


@query("SELECT CAST(row_number() OVER (ORDER BY length(name), id) AS INTEGER) AS place, id, row_number() OVER (ORDER BY length(name), id) <= 8 AS first_page FROM parts ORDER BY length(name), id LIMIT 50")
def page_results(spark, sf_dir):
    """First 8, up to 50, then a row that leads to more (the flag)."""
    rows = R.numbered(catalog.parts(spark, sf_dir), F.length("name"), "id", limit=50)
    return rows.select("place", "id", (F.col("place") <= 8).alias("first_page"))


@query("SELECT row_number() OVER (ORDER BY lower(name), id) AS place, id FROM parts")
def sort_columns(spark, sf_dir):
    return R.numbered(catalog.parts(spark, sf_dir), F.lower("name"), "id").select("place", "id")


@query("SELECT row_number() OVER (ORDER BY size DESC, id) AS place, id, size FROM parts")
def token_sort(spark, sf_dir):
    return R.placed(R.apply_tokens(catalog.parts(spark, sf_dir), ("s-",)).select("id", "size"))


@query("SELECT row_number() OVER (ORDER BY size, id) AS place, id, size FROM parts WHERE ext IN ('economy', 'promo')")
def token_chain(spark, sf_dir):
    return R.placed(R.apply_tokens(catalog.parts(spark, sf_dir), (".economy.promo", "s")).select("id", "size"))


@query("SELECT name FROM (SELECT DISTINCT p_name AS name, CASE WHEN starts_with(p_name, 'r') THEN 0 ELSE 1 END AS tier FROM part WHERE contains(p_name, 'r')) ORDER BY tier, name LIMIT 15")
def prefix_then_contains(spark, sf_dir):
    names = catalog.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().where(F.col("name").contains("r"))
    return names.orderBy(F.when(F.col("name").startswith("r"), 0).otherwise(1), "name").limit(15).select("name")


@query("""SELECT keyword, path, last_at FROM (SELECT keyword, path, last_at, row_number() OVER (PARTITION BY keyword ORDER BY last_at DESC) AS k FROM (
 SELECT event_type AS keyword, user_id AS path, event_id AS last_at, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1) WHERE k <= 20""")
def history_mru(spark, sf_dir):
    """A path lives under the keyword of its last use; 20 newest per keyword. The last use is an aggregate, so a hot path
    costs each task one row; the per-keyword limit is applied before the shuffle by the window group limit."""
    last = catalog.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("path")).agg(F.max("event_id").alias("last_at"), F.max_by("event_type", "event_id").alias("keyword"))
    return last.withColumn("k", F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("last_at")))).where("k <= 20").select("keyword", "path", "last_at")


@query("SELECT lower(event_type || '-' || user_id) AS keyword, max(event_id) AS last_at FROM events GROUP BY 1 ORDER BY last_at DESC LIMIT 2000")
def keyword_mru(spark, sf_dir):
    words = catalog.table(spark, sf_dir, "events").select(F.lower(F.concat_ws("-", "event_type", F.col("user_id").cast("string"))).alias("keyword"), F.col("event_id").alias("last_at"))
    return words.groupBy("keyword").agg(F.max("last_at").alias("last_at")).orderBy(F.desc("last_at")).limit(2000)


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE regexp_matches(lower(n_name), '^[^n]*n[^t]*t[^1]*1') ORDER BY n_nationkey LIMIT 8")
def list_first_n(spark, sf_dir):
    settings = catalog.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return R.keyword_list(settings, "set nt1", "set", "name")


@query("SELECT min(id) AS id, lower(path) AS path FROM parts GROUP BY lower(path)")
def distinct_path(spark, sf_dir):
    """First by id of each path, case ignored; as an aggregate, so that hot paths combine before the shuffle."""
    return catalog.parts(spark, sf_dir).groupBy(F.lower("path").alias("path")).agg(F.min("id").alias("id"))


@query("SELECT l_partkey, name, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN parts ON l_partkey = id WHERE contains(lower(name), 'bolt') GROUP BY l_partkey, name")
def join_fanout_scale(spark, sf_dir):
    """Name hits fanned out to a fact table: names are matched once, the facts are pre-aggregated before they are joined."""
    from quarry.functions import query as Q

    rows = catalog.parts(spark, sf_dir)
    hits = N.fan_out(N.matching_names(rows, Q.parse_pattern("'bolt")), rows).select(F.col("id").alias("l_partkey"), "name")
    facts = catalog.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return facts.join(hits, "l_partkey").select("l_partkey", "name", "n", "qty")
