"""Queries of sources, row filters, tree joins, path operators and aggregates."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import query as Q
from quarry.functions.globs import glob_regex, pattern_list
from quarry.functions import predicates as P
from quarry.operators import aggregates as A
from quarry.operators import exclusions as E
from quarry.operators import filters as X
from quarry.operators import joins as J
from quarry.operators import maintenance as M
from quarry.operators import paths as H
from quarry.operators import ranking as R
from quarry.operators import tree as W
from quarry.operators.storage import Snapshots, cut_lineage, remove_folder, shared_folder
from quarry.plans.registry import query, sql_query
from quarry.sources import catalog

# ---- sources and sinks
sql_query("src_history_topn", "SELECT page_id, url FROM pages WHERE url LIKE 'http%' ORDER BY page_id DESC LIMIT 2000")
sql_query("src_json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click'", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click'")


@query("SELECT usn, id, reason, size, (SELECT max(usn) + 1 FROM journal) AS next_usn FROM journal WHERE usn >= (SELECT max(usn) // 3 FROM journal)")
def src_journal_catchup(spark, sf_dir):
    """The journal from the offset that a snapshot's header has stored on, with the offset to store next."""
    store, journal = Snapshots(spark), catalog.journal(spark, sf_dir)
    kept = journal.agg((F.floor(F.max("usn") / 3)).alias("usn")).first()["usn"] or 0
    header = store.header(store.write(catalog.parts(spark, sf_dir).select("id", "name", "source_key"), journal_id=7, next_usn=kept)).first()
    return M.journal_since(journal, header, 7).select("usn", "id", "reason", "size", "next_usn")


@query("SELECT id, parent_id, name, is_dir, size FROM tree")
def src_tree(spark, sf_dir):
    return catalog.tree(spark, sf_dir).select("id", "parent_id", "name", "is_dir", "size")


@query("SELECT b.conv_id AS conv_id, b.turn AS turn, CASE WHEN b.role <> 'system' AND b.role <> '' THEN b.role WHEN d.source IS NOT NULL THEN d.source ELSE d.lang END AS title, d.doc_id AS doc_id FROM conversations b, documents d WHERE b.conv_id = d.doc_id")
def src_bookmark_join(spark, sf_dir):
    """Every turn as a bookmark of the document of its conversation's number."""
    marks = catalog.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("place"), "turn", F.when(F.col("role") != "system", F.col("role")).alias("title"))
    places = catalog.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), F.coalesce("source", "lang").alias("title"))
    return J.bookmarks(marks, places).select(F.col("place").alias("conv_id"), "turn", "title", F.col("place").alias("doc_id"))


@query("""SELECT page_id, array_to_string(string_split(path, '/')[:-2], '/') AS folder, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth, name, url
 FROM page_paths WHERE regexp_matches(url, '^https?://')""")
def src_json_tree(spark, sf_dir):
    """Bookmark files, one for each page, with a folder inside a folder for each part of its path, flattened depth first."""
    from quarry.sources.bookmarks import flatten

    pages = catalog.page_paths(spark, sf_dir)
    parts = F.split("path", "/")
    text = lambda c: F.to_json(F.struct(c.alias("s")))
    quoted = lambda c: F.regexp_extract(text(c), r'^\{"s":(.*)\}$', 1)
    leaf = F.concat(F.lit('{"type":"url","name":'), quoted(F.element_at(parts, -1)), F.lit(',"url":'), quoted(F.col("url")), F.lit("}"))
    nested = F.aggregate(F.reverse(F.slice(parts, 1, F.size(parts) - 1)), leaf, lambda inner, name: F.concat(F.lit('{"type":"folder","name":'), quoted(name), F.lit(',"children":['), inner, F.lit("]}")))
    return flatten(pages.select("page_id", nested.alias("bookmarks")), "page_id", "bookmarks")


@query("SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part")
def src_snapshot(spark, sf_dir):
    """A stored snapshot, opened again: the schema comes from its footers, rows are read by what uses them."""
    store = Snapshots(spark)
    rows = catalog.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.lit("P").alias("source_key"))
    return store.read(store.write(rows)).select("id", "name", "size")


@query("SELECT count(*) AS n_rows, min(p_partkey) AS min_id, max(p_partkey) AS max_id, CAST(7 AS BIGINT) AS journal_id, (SELECT max(event_id) + 1 FROM events) AS next_usn FROM part")
def src_header_counts(spark, sf_dir):
    """Counts and offset of a snapshot from its header alone."""
    store = Snapshots(spark)
    next_usn = catalog.journal(spark, sf_dir).agg(F.max("usn") + 1).first()[0]
    return store.header(store.write(catalog.parts(spark, sf_dir).select("id", "name", "size", "source_key"), journal_id=7, next_usn=next_usn or 0))


@query("SELECT id, name FROM parts WHERE contains(lower(name), 'bolt') AND starts_with(path, 'P:/Brand#3/')")
def src_live_scan(spark, sf_dir):
    """A directory that no catalog holds, scanned as it is: the same predicates over the raw rows, with no dictionary."""
    rows = catalog.parts(spark, sf_dir).where(E.under(F.col("path"), ["p:/brand#3"]))
    return rows.where(P.pattern_column(F.col("name"), Q.parse_pattern("'bolt"))).select("id", "name")


@query("""WITH u AS (SELECT DISTINCT host, list_slice(string_split(path, '/'), 1, k) AS parts, k FROM page_paths, unnest(range(1, 9)) AS r(k) WHERE k <= len(string_split(path, '/')))
SELECT array_to_string(parts, '/') AS path, parts[len(parts)] AS name, CAST(k AS INTEGER) AS depth FROM u""")
def src_url_tree(spark, sf_dir):
    """Directory rows of a walked web source: distinct prefixes of the paths."""
    parts = catalog.page_paths(spark, sf_dir).select(F.split("path", "/").alias("parts"))
    prefixes = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(k.alias("depth"), F.slice("parts", 1, k).alias("p")))).alias("x"))
    return prefixes.select(F.array_join("x.p", "/").alias("path"), F.element_at("x.p", -1).alias("name"), F.col("x.depth").alias("depth")).distinct()


@query("""WITH s AS (SELECT name, size % 5 AS target, min(id) AS id FROM parts GROUP BY name, size % 5), a AS (SELECT min(id) AS id, name FROM parts WHERE starts_with(name, 'red') GROUP BY name)
 SELECT id, name, 'app' AS kind FROM a UNION ALL SELECT id, name, 'shortcut' FROM s WHERE lower(name) NOT IN (SELECT lower(name) FROM a)""")
def src_items_dedup(spark, sf_dir):
    """Item catalog: one shortcut of each target within a name, and none of a name that an app has."""
    rows = catalog.parts(spark, sf_dir)
    apps = rows.where("name like 'red%'").groupBy("name").agg(F.min("id").alias("id"))
    return J.items(rows.select("id", "name", (F.col("size") % 5).alias("target")), apps)


def _registry():
    from quarry.operators.providers import DirectoryRegistry

    found = DirectoryRegistry()
    found.register("gone", "blog.tionsh.example.net")
    found.register("blog", "Blog.tionsh.example.net\\EN\\", False)
    found.register("blog", "blog.tionsh.example.net", True, "9*;*1")
    found.register("org", "thther.example.org", True, "*5*")
    found.register("org", "thther.example.org", False)
    found.unregister("gone")
    return found


_REGISTERED = """SELECT CASE WHEN s[1] = 'thther.example.org' THEN 'org' ELSE 'blog' END AS owner, page_id, path FROM (SELECT page_id, path, string_split(path, '/') AS s FROM page_paths)
 WHERE (s[1] = 'blog.tionsh.example.net' AND ((s[2] = 'en' AND len(s) = 3) OR s[-1] LIKE '9%' OR s[-1] LIKE '%1')) OR (s[1] = 'thther.example.org' AND (s[-1] LIKE '%5%' OR len(s) = 2))"""


@query(_REGISTERED)
def src_registered_dirs(spark, sf_dir):
    """What lies in the directories that providers have registered: some with all below, some with their own files alone."""
    return _registry().listed(catalog.page_paths(spark, sf_dir).select("page_id", "path"))


@query(f"SELECT page_id, path FROM ({_REGISTERED}) WHERE owner = 'blog' AND regexp_extract(path, '[^/]*$') LIKE '%1%'")
def search_registered_dirs(spark, sf_dir):
    """Plain containment in the names of one provider's rows."""
    return _registry().search(catalog.page_paths(spark, sf_dir).select("page_id", "path"), "blog", "1")


@query(f"SELECT owner, count(*) AS changes FROM (SELECT id % (SELECT count(*) FROM pages) AS page_id FROM journal) JOIN ({_REGISTERED}) USING (page_id) GROUP BY owner")
def changed_dirs(spark, sf_dir):
    """Which providers a journal concerns, and how often."""
    pages = catalog.page_paths(spark, sf_dir)
    n = pages.count()
    changes = catalog.journal(spark, sf_dir).select((F.col("id") % n).alias("page_id")).join(pages, "page_id")
    return _registry().changed(changes.select("path"))


@query("SELECT id, name, size, source_key FROM parts")
def sink_snapshot_roundtrip(spark, sf_dir):
    """Snapshot written sorted by id within partitions, by source, then read again."""
    store = Snapshots(spark)
    version = store.write(catalog.parts(spark, sf_dir).select("id", "name", "size", "source_key"))
    return store.read(version).select("id", "name", "size", "source_key")


# ---- scope filters
@query("SELECT p_partkey AS id, p_name || '.' || lower(p_type) AS name FROM part")
def filter_drive(spark, sf_dir):
    """A drive word in the query keeps the rows of that source, of the two that the catalog has."""
    both = catalog.parts(spark, sf_dir).select("id", "name", "source_key").unionByName(catalog.tree(spark, sf_dir).select("id", "name", F.lit("T").alias("source_key")))
    return X.on_drive(both, Q.parse_pattern("p: 'x").drive).select("id", "name")


@query("SELECT id, name, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth FROM paths WHERE len(string_split(path, '/')) <= 3")
def filter_depth(spark, sf_dir):
    """What a walk of two levels lists."""
    return X.down_to(W.with_paths(catalog.tree(spark, sf_dir).where("id <> 1"), root=1), 2).select("id", "name", "depth")


@query("SELECT 1000000000 + o_orderkey AS id, 'order-' || o_orderkey || '.' || lower(o_orderstatus) AS name FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-02 00:00:00'")
def filter_modified(spark, sf_dir):
    return X.modified_since(catalog.tree(spark, sf_dir), F.lit("2001-07-02 00:00:00").cast("timestamp")).select("id", "name")


@query("SELECT id, path FROM paths WHERE starts_with(lower(path), 't:/africa/')")
def filter_directory(spark, sf_dir):
    return catalog.paths(spark, sf_dir).where(F.lower("path").startswith("t:/africa/")).select("id", "path")


@query("""WITH RECURSIVE low AS (SELECT id AS scope, id, true AS self FROM tree WHERE name IN ('AFRICA', 'NATION_7', 'Customer#000000004') UNION ALL
 SELECT low.scope, t.id, false FROM tree t JOIN low ON t.parent_id = low.id AND t.id <> t.parent_id) SELECT scope, id FROM low WHERE NOT self""")
def filter_subtree(spark, sf_dir):
    """Several scopes over one labelled tree: each is a range of directory numbers."""
    nodes = catalog.tree(spark, sf_dir)
    labels = cut_lineage(W.subtree_labels(nodes))
    rows = W.labelled(nodes, labels)
    scopes = nodes.where(F.col("name").isin("AFRICA", "NATION_7", "Customer#000000004")).select("id").orderBy("id").limit(3).collect()
    return reduce(DataFrame.unionByName, [W.in_scope(rows, labels, r["id"]).select(F.lit(r["id"]).alias("scope"), "id") for r in scopes], spark.createDataFrame([], "scope long, id long"))


@query("SELECT id, name FROM parts WHERE id % 7 <> 0 AND id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL)")
def filter_live_rows(spark, sf_dir):
    flags = F.when(F.col("id") % 7 == 0, catalog.DELETED).otherwise(0)
    rows = catalog.parts(spark, sf_dir).where(~X.has_flag(flags, catalog.DELETED))
    gone = catalog.journal(spark, sf_dir).where(F.col("reason") == catalog.FILE_DELETE)
    return X.live_rows(rows, gone).select("id", "name")


@query("SELECT id, CAST(id % 64 AS INTEGER) AS flags FROM parts WHERE (id % 64) & 24 = 0")
def filter_hidden(spark, sf_dir):
    rows = catalog.parts(spark, sf_dir).select("id", (F.col("id") % 64).cast("int").alias("flags"))
    return rows.where(X.visible(F.col("flags")))


_ROOTS = ("blog.tionsh.example.net\\\\", "thther.example.org/en/")  # either separator, and one at the end
_GLOBS = ("**/fr/**", "*.example.com", "de", "[not closed")
_REGEXES = ("^7[0-9]+$", "(not closed")
# what they say, without regular expressions made of globs: by the parts of a path
_SQL_ROOTS = "(lower(path) || '/' LIKE 'blog.tionsh.example.net/%' OR lower(path) || '/' LIKE 'thther.example.org/en/%')"
_SQL_GLOBS = "(list_contains(string_split(lower(path), '/')[:-2], 'fr') OR list_contains(string_split(lower(path), '/'), 'de') OR list_bool_or(list_transform(string_split(lower(path), '/'), lambda s: s LIKE '%.example.com')))"
_SQL_REGEXES = "list_bool_or(list_transform(string_split(path, '/'), lambda s: s LIKE '7_%' AND TRY_CAST(s AS BIGINT) IS NOT NULL))"


@query(f"SELECT page_id, path FROM page_paths WHERE NOT {_SQL_ROOTS}")
def filter_excluded_roots(spark, sf_dir):
    rules = E.ExclusionRules.of(spark, roots=_ROOTS)
    return E.surviving(catalog.page_paths(spark, sf_dir).select("page_id", "path"), rules)


@query(f"SELECT page_id, path FROM page_paths WHERE NOT ({_SQL_GLOBS} OR {_SQL_REGEXES})")
def filter_excluded_globs(spark, sf_dir):
    """Globs and regular expressions over directories and names; those that can't be read are skipped."""
    rules = E.ExclusionRules.of(spark, globs=_GLOBS, regexes=_REGEXES)
    return E.surviving(catalog.page_paths(spark, sf_dir).select("page_id", "path"), rules)


@query("""WITH e AS (SELECT page_id, path, string_split(lower(path), '/') AS s FROM page_paths)
SELECT page_id, path FROM e WHERE NOT list_contains(s[:-2], 'fr') AND NOT (
  (s[1] = 'm.ththth.example.net' AND s[2] = 'en') OR (s[1] = 'blog.tionsh.example.net' AND false) OR (s[1] = 'thther.example.org' AND s[2] = 'en'))""")
def filter_bypass(spark, sf_dir):
    """A search scoped to a folder of the blog: the excluded root that holds the folder is lifted, one below another host
    isn't, nor is any pattern."""
    rules = E.ExclusionRules.of(spark, roots=("blog.tionsh.example.net", "M.ththth.example.net/en", "thther.example.org/en"), globs=("**/fr/**",))
    return E.surviving(catalog.page_paths(spark, sf_dir).select("page_id", "path"), rules, exempt=("blog.tionsh.example.net/en",))


_IGNORE = "# comment\nfr/\n!m.*/fr\n*.example.org/en/2*\n"
_INNER = "!fr\n/en\n!en/1*\n"
# each part of a path in turn, with the rules heard there in order, the last that matches deciding; a part that is ignored
# hides all below it
_WALK = """WITH p AS (SELECT page_id, path, string_split(path, '/') AS s FROM page_paths),
k AS (SELECT page_id, path, s, t.k AS k, s[t.k] AS name, t.k < len(s) AS is_dir FROM p, unnest(range(1, 4)) AS t(k) WHERE t.k <= len(s)),
own AS (SELECT page_id, path, {} AS out FROM k)
SELECT page_id, path, bool_or(out) AS ignored FROM own GROUP BY page_id, path"""
_TOP_RULES = "WHEN k = 3 AND s[1] LIKE '%.example.org' AND s[2] = 'en' AND name LIKE '2%' THEN true WHEN k = 2 AND s[1] LIKE 'm.%' AND name = 'fr' THEN false WHEN name = 'fr' AND is_dir THEN true ELSE false END"


@query(_WALK.format("CASE " + _TOP_RULES))
def filter_ignore_rules(spark, sf_dir):
    """Rules of one file at the top: what lies below an ignored directory is ignored, a kept one is entered."""
    from quarry.sources.ignorefiles import rules_frame

    return E.ignored_by(catalog.page_paths(spark, sf_dir).select("page_id", "path"), rules_frame(spark, [("", ".gitignore", _IGNORE)]))


@query(_WALK.format("CASE WHEN s[1] = 'blog.tionsh.example.net' AND k > 1 THEN CASE WHEN k = 3 AND s[2] = 'en' AND name LIKE '1%' THEN false WHEN name = 'en' THEN true WHEN name = 'fr' THEN false ELSE false END " + _TOP_RULES))
def src_ignore_files(spark, sf_dir):
    """Ignore files read from the tree they rule: one at the top, one in a host's folder, which is heard after it; it ignores
    a directory, below which none of its rules can keep anything."""
    from quarry.sources.ignorefiles import read_rules

    folder = f"{shared_folder(spark)}/ignore-{uuid.uuid4().hex}"
    for at, text in (("", _IGNORE), ("/blog.tionsh.example.net", _INNER)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}{at}/.gitignore")
    rules = read_rules(spark, folder)
    remove_folder(spark, folder)
    return E.ignored_by(catalog.page_paths(spark, sf_dir).select("page_id", "path"), rules)


@query("""SELECT DISTINCT path, is_dir, depth FROM (SELECT array_to_string(s[1 : t.k], '/') AS path, t.k < len(s) AS is_dir, CAST(t.k - 1 AS INTEGER) AS depth, s[1] AS host, s[2] AS lang
  FROM (SELECT string_split(path, '/') AS s FROM page_paths), unnest(range(1, 4)) AS t(k) WHERE t.k <= len(s)) WHERE depth <= 1 AND host NOT LIKE '%.example.com' AND NOT (depth = 1 AND lang = 'fr')""")
def walk_gates(spark, sf_dir):
    """A walk of one level down, by excluded globs, ignored directories and depth at once."""
    from quarry.sources.ignorefiles import rules_frame

    parts = F.split("path", "/")
    each = catalog.page_paths(spark, sf_dir).select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), (k < F.size(parts)).alias("is_dir")))).alias("depth", "x"))
    rows = each.select("x.path", "x.is_dir", "depth").distinct()
    rules = rules_frame(spark, [("", ".ignore", "fr/\n")])
    return E.walked(rows, rules, E.ExclusionRules.of(spark, globs=("*.example.com",)), max_depth=1, is_dir="is_dir")


@query("WITH e AS (SELECT page_id, path, string_split(path, '/') AS s FROM page_paths) SELECT page_id, path FROM e WHERE lower(s[-2]) IN ('en', 'es') AND (s[-1] LIKE '1%' OR s[-1] LIKE '2_')")
def glob_match(spark, sf_dir):
    return catalog.page_paths(spark, sf_dir).where(F.col("path").rlike(glob_regex("**/e[ns]/{1*,2?}"))).select("page_id", "path")


@query("SELECT id, name FROM parts WHERE ext IN ('economy', 'promo')")
def filter_type(spark, sf_dir):
    return catalog.parts(spark, sf_dir).where(F.col("ext").isin("economy", "promo")).select("id", "name")


@query("SELECT id, size, CASE WHEN size < 1048576 THEN 'small' WHEN size <= 104857600 THEN 'medium' ELSE 'large' END AS bucket FROM parts")
def filter_size(spark, sf_dir):
    size = F.col("size")
    bucket = F.when(X.size_bucket(size, "small"), "small").when(X.size_bucket(size, "medium"), "medium").when(X.size_bucket(size, "large"), "large")
    return catalog.parts(spark, sf_dir).select("id", "size", bucket.alias("bucket"))


@query("SELECT id, name FROM parts WHERE (ext = 'economy' OR ext = 'promo') AND (size < 1048576 OR size > 104857600)")
def filter_sidebar(spark, sf_dir):
    groups = [[F.col("ext") == "economy", F.col("ext") == "promo"], [X.size_bucket(F.col("size"), "small"), X.size_bucket(F.col("size"), "large")]]
    return catalog.parts(spark, sf_dir).where(X.all_of(map(X.any_of, groups))).select("id", "name")


@query("SELECT id, name FROM parts WHERE lower(name) LIKE '%.economy' OR lower(name) LIKE '%.standard'")
def token_ext(spark, sf_dir):
    return R.apply_tokens(catalog.parts(spark, sf_dir), (".economy.standard",)).select("id", "name")


@query("SELECT page_id, path FROM page_paths WHERE list_bool_or(list_transform(string_split(path, '/'), lambda s: regexp_matches(lower(s), '^[^b]*b[^g]*g[^n]*n')))")
def token_segment(spark, sf_dir):
    return R.apply_tokens(catalog.page_paths(spark, sf_dir), (":bgn",)).select("page_id", "path")


@query("SELECT id, name FROM parts LIMIT 0")
def token_unknown(spark, sf_dir):
    return R.apply_tokens(catalog.parts(spark, sf_dir), ("nobody",)).select("id", "name")


@query("SELECT id, name FROM parts WHERE name LIKE '%.economy' OR name LIKE 'red%'")
def filter_patterns(spark, sf_dir):
    return catalog.parts(spark, sf_dir).where(F.col("name").rlike(pattern_list("*.economy; red*"))).select("id", "name")


@query("""SELECT 'brand7' AS text, id, name, CAST(1.0 AS DOUBLE) AS weight FROM parts WHERE folder = 'Brand#7' UNION ALL SELECT 'brand7 bolt', id, name, round(4.0 / length(name), 9) FROM parts WHERE folder = 'Brand#7' AND contains(lower(name), 'bolt')""")
def items_keyword(spark, sf_dir):
    """A bare registered keyword lists its own items at weight 1 and hides all others; what follows it filters and weighs
    them; another text shows none."""
    rows = catalog.parts(spark, sf_dir)
    shown = lambda text: R.keyword_items(rows, text, "brand7", F.col("folder") == "Brand#7").select(F.lit(text.replace("'", "")).alias("text"), "id", "name", F.round("weight", 9).alias("weight"))
    return shown("brand7").unionByName(shown("brand7 'bolt")).unionByName(shown("brand8"))


@query("SELECT id, name FROM parts WHERE folder NOT IN ('Brand#1', 'Brand#2')")
def filter_reachable(spark, sf_dir):
    offline = spark.createDataFrame([("Brand#1",), ("Brand#2",)], "folder string")
    return catalog.parts(spark, sf_dir).join(offline, "folder", "left_anti").select("id", "name")


@query("SELECT id, path FROM paths WHERE starts_with(path, 'T:/ASIA/')")
def filter_self(spark, sf_dir):
    parsed = Q.parse_query("T:/ASIA/")
    rows = catalog.paths(spark, sf_dir).where(E.under(F.col("path"), [parsed.exact_path]))
    return rows.where(F.lower("path") != parsed.exact_path).select("id", "path")


_TIER = "CASE WHEN starts_with(lower(c_name), '11') THEN 0 WHEN contains(lower(c_name), '#11') THEN 1 WHEN contains(lower(c_name), '11') THEN 2 WHEN regexp_matches(lower(c_name), '^[^1]*1[^1]*1') THEN 3 END"


@query(f"SELECT c_custkey, c_name, {_TIER} AS tier FROM customer WHERE {_TIER} IS NOT NULL")
def tiered_match(spark, sf_dir):
    return catalog.table(spark, sf_dir, "customer").select("c_custkey", "c_name", X.tier(F.col("c_name"), "11").alias("tier")).where("tier IS NOT NULL")


@query(f"SELECT c_custkey, c_name, {_TIER} AS tier FROM customer WHERE {_TIER} IS NOT NULL ORDER BY tier, c_name LIMIT 50")
def tiered_topk(spark, sf_dir):
    return tiered_match(spark, sf_dir).orderBy("tier", "c_name").limit(50)


# ---- tree joins and paths
@query("""SELECT 1000 + r_regionkey AS id, r_name AS name, '' AS parent FROM region UNION ALL SELECT 10000 + n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 1000000 + c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 1000000000 + o_orderkey, 'order-' || o_orderkey || '.' || lower(o_orderstatus), c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_parent(spark, sf_dir):
    return J.with_parent(catalog.tree(spark, sf_dir)).select("id", "name", "parent")


@query("SELECT id, CASE WHEN id % 5 = 0 OR parent_id NOT IN (SELECT id FROM tree) THEN 1 ELSE parent_id END AS parent FROM tree")
def join_orphans(spark, sf_dir):
    rows = catalog.tree(spark, sf_dir).select("id", F.when(F.col("id") % 5 == 0, -F.col("id")).otherwise(F.col("parent_id")).alias("parent_id"))
    return J.adopted(rows)


@query("SELECT 1000000 + c_custkey AS id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' AND contains(lower(c_name), 'customer')")
def path_children(spark, sf_dir):
    below = J.children_of(catalog.tree(spark, sf_dir), F.col("name") == "NATION_3")
    return below.where(P.pattern_column(F.col("name"), Q.parse_pattern("'customer"))).select("id", "name")


@query("SELECT id, size FROM parts WHERE lower(path) IN (SELECT lower(path) FROM parts WHERE id % 100 = 0)")
def join_metadata_batch(spark, sf_dir):
    rows = catalog.parts(spark, sf_dir)
    return J.with_metadata(rows, rows.where("id % 100 = 0")).select("id", "size")


@query("SELECT id, unnest(ancestors) AS ancestor FROM paths")
def join_ancestors(spark, sf_dir):
    return W.closure(catalog.tree(spark, sf_dir))


@query("SELECT id, path, depth FROM paths")
def project_full_path(spark, sf_dir):
    """From parent ids alone, whatever the depth."""
    return W.with_paths(catalog.tree(spark, sf_dir).where("id <> 1"), root=1).select("id", "path", "depth")


@query("SELECT id, name, path, is_dir, CASE WHEN is_dir THEN 'D' ELSE 'F' END AS kind, substr(path, 1, 1) AS drive, modified FROM paths")
def project_result(spark, sf_dir):
    return R.result_columns(catalog.paths(spark, sf_dir))


@query("""WITH s AS (SELECT DISTINCT host AS source FROM page_paths UNION SELECT DISTINCT host || '/en' FROM page_paths)
SELECT page_id, path, max_by(source, length(source)) AS source FROM page_paths JOIN s ON path = source OR starts_with(path, source || '/') GROUP BY page_id, path""")
def join_longest_prefix(spark, sf_dir):
    rows = catalog.page_paths(spark, sf_dir)
    hosts = rows.select("host").distinct()
    sources = hosts.select(F.col("host").alias("source")).union(hosts.select(F.concat("host", F.lit("/en"))))
    return J.with_source(rows.select("page_id", "path"), sources)


@query("SELECT id, path FROM (SELECT id, path, names[:len(names) - 1] AS up, name FROM paths) WHERE regexp_matches(lower(name), '^[^o]*o[^1]*1[^2]*2') AND list_bool_or(list_transform(range(1, len(up) + 1), lambda j: contains(lower(up[j]), 'nation_') AND list_bool_or(list_transform(range(1, j), lambda i: starts_with(lower(up[i]), 'a')))))")
def path_fuzzy(spark, sf_dir):
    """Match part: '^a' then ''nation_' met right to left by the directories, the name by a fuzzy term."""
    rows = catalog.paths(spark, sf_dir)
    up = F.slice("names", 1, F.size("names") - 1)
    name = P.pattern_column(F.col("name"), Q.parse_pattern("o12"))
    return rows.where(name & H.positional_match(up, ["^a", "'nation_"])).select("id", "path")


@query()
def rank_path(spark, sf_dir):
    return H.search_path(catalog.paths(spark, sf_dir), "t:/e/_3/12", 20).select("id", "path", "score", "dir_score", "k_score", "k_length", "k_span", "k_position")


@query("""SELECT id, path FROM paths WHERE (contains(lower(name), 'order-12') OR contains(lower(name), 'asia'))
 AND (contains(lower(path), 'order-12') AND contains(lower(path), '/asia')) AND NOT (contains(lower(name), 'order-12') AND contains(lower(name), 'asia')) ORDER BY id LIMIT 500""")
def path_term_fallback(spark, sf_dir):
    return H.term_fallback(catalog.paths(spark, sf_dir), "'order-12 'asia", 500).select("id", "path")


# ---- aggregates
@query("""SELECT r_name AS source, 1 + (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) + (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS dirs,
 (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS files FROM region""")
def agg_counts_by_source(spark, sf_dir):
    rows = catalog.paths(spark, sf_dir)
    return A.counts_by(rows, F.split_part("path", F.lit("/"), F.lit(2)), F.col("is_dir"))


@query("SELECT count(*) AS n, CAST(sum(65536 * CAST(p_size AS BIGINT) * p_size) AS BIGINT) AS size FROM part")
def agg_totals(spark, sf_dir):
    return A.totals(catalog.parts(spark, sf_dir))


@query("SELECT CAST(greatest(0, (SELECT count(*) FROM part) + (SELECT count(*) FROM events WHERE event_type = 'signup') - (SELECT count(*) FROM events WHERE event_type = 'error')) AS BIGINT) AS live")
def agg_live_counts(spark, sf_dir):
    return A.live_count(catalog.parts(spark, sf_dir), catalog.journal(spark, sf_dir))


@query("SELECT folder, CAST(greatest(0, count(*) - count(*) FILTER (WHERE gone)) AS BIGINT) AS live FROM (SELECT p_brand AS folder, EXISTS (SELECT 1 FROM events WHERE event_type = 'error' AND user_id = p_partkey) AS gone FROM part) GROUP BY folder")
def agg_live_counts_by_folder(spark, sf_dir):
    """Counts of each folder kept up by the journal."""
    rows = catalog.parts(spark, sf_dir)
    gone = catalog.journal(spark, sf_dir).where(F.col("reason") == catalog.FILE_DELETE).select("id").distinct()
    return A.live_counts_by(rows, rows.join(gone, "id").select("folder", F.lit(-1).alias("step")), "folder")


@query("SELECT p_name || '.' || lower(p_type) AS name, count(*) AS n FROM part GROUP BY p_name, lower(p_type)")
def agg_distinct_names(spark, sf_dir):
    return A.dictionary(catalog.parts(spark, sf_dir))


@query("""SELECT CAST(1 AS BIGINT) AS parent_id, count(*) AS n FROM region UNION ALL SELECT 1000 + n_regionkey, count(*) FROM nation GROUP BY 1
 UNION ALL SELECT 10000 + c_nationkey, count(*) FROM customer GROUP BY 1 UNION ALL SELECT 1000000 + o_custkey, count(*) FROM orders GROUP BY 1""")
def agg_children(spark, sf_dir):
    return A.children(catalog.tree(spark, sf_dir))


@query("SELECT DISTINCT ON (name) name, score AS best, first_id FROM (SELECT name, id * 7 % 101 AS score, min(id) OVER (PARTITION BY name) AS first_id FROM parts) ORDER BY name, score DESC")
def agg_best_alias(spark, sf_dir):
    return A.best_by(catalog.parts(spark, sf_dir), "name", F.col("id") * 7 % 101)


@query("SELECT folder, name, id FROM parts QUALIFY row_number() OVER (PARTITION BY folder ORDER BY id) = 1")
def agg_first_of_group(spark, sf_dir):
    return R.first_of(catalog.parts(spark, sf_dir).select("folder", "name", "id"), "folder", "id")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE url IS NULL) AS skipped, count(*) FILTER (WHERE host = '') AS errors, count(DISTINCT host) AS sources FROM page_paths")
def agg_ingest_stats(spark, sf_dir):
    return A.walk_statistics(catalog.page_paths(spark, sf_dir), F.col("url"), F.col("host"))


@query("SELECT folder, CAST(max(CASE WHEN contains(name, 'bolt') THEN 1 ELSE 0 END) + max(CASE WHEN contains(name, 'red') THEN 2 ELSE 0 END) AS INTEGER) AS mask FROM parts GROUP BY folder")
def agg_term_mask(spark, sf_dir):
    return A.term_mask(catalog.parts(spark, sf_dir), "folder", [F.col("name").contains("bolt"), F.col("name").contains("red")])


@query("SELECT sha256(string_agg(v, ';' ORDER BY v)) AS fingerprint FROM (SELECT DISTINCT trim(folder) AS v FROM parts)")
def agg_fingerprint(spark, sf_dir):
    return A.fingerprint(catalog.parts(spark, sf_dir), "folder")
