"""Queries of change-data maintenance and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import maintenance as M
from quarry.operators import tree as H
from quarry.operators.storage import Snapshots
from quarry.plans.registry import query
from quarry.sources import catalog


def _changes(spark, sf_dir, *more):
    """The journal as link changes of the parts' folders, with toggles and renames dealt in by usn, and more of its columns."""
    usn = F.col("usn")
    reason = F.when(usn % 11 == 0, catalog.HARD_LINK).when(usn % 13 == 0, catalog.RENAME_OLD).otherwise(F.col("reason"))
    name = F.when(usn % 4 == 0, F.concat(F.lit("link-"), (usn % 3).cast("string"))).otherwise(F.concat(F.lit("part-"), F.col("id").cast("string")))
    rows = catalog.journal(spark, sf_dir).where("id is not null").withColumn("reason", reason)
    return rows.select("id", "usn", (F.col("id") % 10).alias("parent_id"), name.alias("name"), M.reason_action(F.col("reason")).alias("action"), M.refreshes(F.col("reason")).alias("refresh"), "size", F.lit("P").alias("source_key"), *more)


def _links(spark, sf_dir):
    return catalog.parts(spark, sf_dir).select("id", (F.col("id") % 10).alias("parent_id"), F.concat(F.lit("part-"), F.col("id").cast("string")).alias("name"), "size", "source_key")


_ACTION = "CASE reason WHEN 65536 THEN 'toggle' WHEN 4096 THEN 'hide' WHEN 512 THEN 'remove' WHEN 256 THEN 'add' WHEN 8192 THEN 'add' WHEN 2 THEN 'refresh' WHEN 32768 THEN 'refresh' ELSE 'skip' END"
_LAST = f"SELECT id, usn, {_ACTION} AS action, size FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY usn DESC) AS rn FROM journal WHERE id IS NOT NULL) WHERE rn = 1"
# by the rules of the journal: the last add, remove or hide of a link says whether it is there, each toggle after it
# (or all, where there is none) turns that round; an id's size is that of its last record that is a create, a rename's
# new name or a change of data or attributes, and not a delete, or of the link's own last add or toggle, if that is later;
# a link without such a record keeps the base's size
_REPLAY = f"""WITH ch AS (SELECT usn, id, id % 10 AS parent_id, CASE WHEN usn % 4 = 0 THEN 'link-' || (usn % 3) ELSE 'part-' || id END AS name, size,
   CASE WHEN usn % 11 = 0 THEN 65536 WHEN usn % 13 = 0 THEN 4096 ELSE reason END AS reason FROM journal WHERE id IS NOT NULL),
 mem AS (SELECT *, max(CASE WHEN reason <> 65536 THEN usn END) OVER (PARTITION BY id, parent_id, name) AS set_usn FROM ch WHERE reason IN (65536, 4096, 512, 256, 8192)),
 link AS (SELECT id, parent_id, name, max(CASE WHEN usn = set_usn THEN CASE WHEN reason IN (256, 8192) THEN 1 ELSE 0 END END) AS there, count(*) FILTER (WHERE reason = 65536 AND (set_usn IS NULL OR usn > set_usn)) AS flips,
   max(usn) FILTER (WHERE reason IN (65536, 256, 8192)) AS made_usn, max_by(size, usn) FILTER (WHERE reason IN (65536, 256, 8192)) AS made_size FROM mem GROUP BY id, parent_id, name),
 base AS (SELECT id, id % 10 AS parent_id, 'part-' || id AS name, size FROM parts),
 met AS (SELECT coalesce(b.id, l.id) AS id, coalesce(b.parent_id, l.parent_id) AS parent_id, coalesce(b.name, l.name) AS name, b.size AS size, l.made_usn AS made_usn, l.made_size AS made_size,
   (coalesce(l.there, CASE WHEN b.id IS NULL THEN 0 ELSE 1 END) + coalesce(l.flips, 0)) % 2 AS present
   FROM base b FULL OUTER JOIN link l ON b.id = l.id AND b.parent_id = l.parent_id AND b.name = l.name),
 stat AS (SELECT id, max(usn) AS usn, max_by(size, usn) AS size FROM ch WHERE reason IN (256, 8192, 2, 32768) GROUP BY id)"""
_COMPACT = _REPLAY + " SELECT met.id AS id, parent_id, name, CASE WHEN stat.usn >= coalesce(made_usn, stat.usn) THEN stat.size WHEN made_usn IS NOT NULL THEN made_size ELSE met.size END AS size FROM met LEFT JOIN stat ON stat.id = met.id WHERE present = 1"


@query(f"SELECT usn, id, {_ACTION} AS action FROM journal")
def cdc_reason(spark, sf_dir):
    return catalog.journal(spark, sf_dir).select("usn", "id", M.reason_action(F.col("reason")).alias("action"))


@query(_LAST)
def cdc_upsert(spark, sf_dir):
    rows = catalog.journal(spark, sf_dir).where("id is not null").select("id", "usn", M.reason_action(F.col("reason")).alias("action"), "size")
    return M.last_by(rows, "id").select("id", "usn", "action", "size")


@query(_COMPACT)
def cdc_compact(spark, sf_dir):
    return M.compact(_links(spark, sf_dir), _changes(spark, sf_dir)).select("id", "parent_id", "name", "size")


@query(_REPLAY + " SELECT id, parent_id, name FROM met WHERE present = 1")
def cdc_links(spark, sf_dir):
    """Membership of each link alone: one id may have several, each with its own history."""
    return M.apply_links(_links(spark, sf_dir), _changes(spark, sf_dir)).select("id", "parent_id", "name")


@query("SELECT p.id AS id, coalesce(m.size, p.size) AS size FROM parts p LEFT JOIN (SELECT id, arg_max(size, usn) AS size FROM journal WHERE reason IN (2, 256, 8192, 32768) GROUP BY id) m ON p.id = m.id")
def cdc_metadata_overlay(spark, sf_dir):
    changes = catalog.journal(spark, sf_dir).withColumn("refresh", M.refreshes(F.col("reason")))
    return M.overlay_metadata(catalog.parts(spark, sf_dir).select("id", "size"), changes)


_RENAMED = "SELECT 10000 + n_nationkey AS id, 'renamed-' || n_nationkey AS new_name FROM nation WHERE n_nationkey % 4 = 0"


@query(f"""WITH RECURSIVE now AS (SELECT t.id, t.parent_id, coalesce(r.new_name, t.name) AS name FROM tree t LEFT JOIN ({_RENAMED}) r ON r.id = t.id),
 r AS (SELECT id, 'T:/' || name AS path FROM now WHERE parent_id = 1 AND id <> 1 UNION ALL SELECT now.id, r.path || '/' || now.name FROM now JOIN r ON now.parent_id = r.id) SELECT id, path FROM r""")
def cdc_rename(spark, sf_dir):
    """Directories renamed over the journal, old name hidden and new one added; what is below follows by parent id."""
    nodes = catalog.tree(spark, sf_dir).select("id", "parent_id", "name", "size")
    moved = nodes.join(catalog.table(spark, sf_dir, "nation").where("n_nationkey % 4 = 0").select((10000 + F.col("n_nationkey")).cast("long").alias("id"), "n_nationkey"), "id")
    new = F.concat(F.lit("renamed-"), F.col("n_nationkey").cast("string"))
    record = lambda step, name, reason: moved.select("id", "parent_id", name.alias("name"), "size", (F.col("n_nationkey") * 2 + step).cast("long").alias("usn"), M.reason_action(F.lit(reason)).alias("action"), F.lit(False).alias("refresh"))
    changes = record(0, F.col("name"), catalog.RENAME_OLD).unionByName(record(1, new, catalog.RENAME_NEW))
    return H.with_paths(M.compact(nodes, changes, directories=True)).select("id", "path")


@query("""SELECT id, CASE WHEN min(side) = 2 THEN 'added' WHEN max(side) = 1 THEN 'removed' WHEN min(size) = max(size) THEN 'reused' ELSE 'changed' END AS status
 FROM (SELECT id, size, 1 AS side FROM parts WHERE id % 5 <> 0 UNION ALL SELECT id, CASE WHEN id % 9 = 0 THEN size + 1 ELSE size END, 2 FROM parts WHERE id % 6 <> 0) GROUP BY id""")
def cdc_diff(spark, sf_dir):
    """Two scans of the parts: some ids are only in the first, some only in the second, some have another size there."""
    rows = catalog.parts(spark, sf_dir).select("id", "size")
    now = rows.where("id % 6 <> 0").withColumn("size", F.when(F.col("id") % 9 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return M.diff(rows.where("id % 5 <> 0"), now, ("size",))


@query("SELECT id, parent_id FROM (SELECT id, id % 10 AS parent_id FROM parts WHERE id % 2 = 0 AND id NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) % 2 = 1) UNION ALL SELECT user_id, user_id % 10 FROM events GROUP BY user_id HAVING count(*) % 2 = 1 AND user_id NOT IN (SELECT id FROM parts WHERE id % 2 = 0))")
def cdc_toggle(spark, sf_dir):
    links = catalog.parts(spark, sf_dir).where("id % 2 = 0").select("id", (F.col("id") % 10).alias("parent_id"))
    toggles = catalog.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.col("user_id") % 10).alias("parent_id"))
    return M.toggled(links, toggles, "id", "parent_id")


@query("""WITH RECURSIVE gone AS (SELECT id FROM tree WHERE name IN ('ASIA', 'NATION_2') UNION SELECT t.id FROM tree t JOIN gone g ON t.parent_id = g.id AND t.id <> t.parent_id) SELECT id FROM gone""")
def cdc_cascade(spark, sf_dir):
    nodes = catalog.tree(spark, sf_dir)
    return H.cascade(nodes, nodes.where(F.col("name").isin("ASIA", "NATION_2")))


# the records by what the rest of usn / 9 says; a page's path is that of the page whose number the record's id leaves
_PATH_CHANGES = """SELECT usn, CASE WHEN k IN (0, 2) THEN folder WHEN k = 1 THEN host WHEN k IN (3, 4) THEN path || '/new/' || (usn % 3) WHEN k = 5 THEN folder || '/tmp' WHEN k = 8 THEN path || '/tmp' ELSE path END AS path,
  k = 2 AS is_dir, CASE WHEN k IN (0, 1, 6) THEN 'remove' ELSE 'add' END AS action, CAST(usn % 1000 AS BIGINT) AS size
 FROM (SELECT j.usn, j.usn % 9 AS k, p.path, p.host, regexp_extract(p.path, '^(.*)/[^/]*$', 1) AS folder FROM journal j JOIN (SELECT page_id, path, host FROM page_paths) p ON p.page_id = j.id % (SELECT count(*) FROM pages) WHERE j.usn % 9 <> 1 OR j.usn % 45 = 1)"""


@query(f"""WITH ch AS ({_PATH_CHANGES}), base AS (SELECT DISTINCT path, false AS is_dir, CAST(1 AS BIGINT) AS size FROM page_paths),
 ups AS (SELECT path, usn, is_dir, CASE WHEN is_dir THEN 0 ELSE size END AS size FROM ch WHERE action = 'add'
   UNION ALL SELECT b.path, c.usn, false, 2 FROM ch c JOIN (SELECT DISTINCT path FROM page_paths WHERE page_id % 2 = 0) b ON c.action = 'add' AND c.is_dir AND starts_with(b.path, c.path || '/')),
 good AS (SELECT * FROM ups WHERE path NOT LIKE '%/tmp'),
 rem AS (SELECT path, max(usn) AS at FROM (SELECT path, usn FROM ch WHERE action = 'remove' UNION ALL SELECT path, usn FROM ups WHERE path LIKE '%/tmp') GROUP BY path),
 way AS (SELECT array_to_string(string_split(path, '/')[1 : t.k], '/') AS path, usn FROM good, unnest(range(1, 9)) AS t(k) WHERE t.k < len(string_split(path, '/'))),
 every AS (SELECT path FROM base UNION SELECT path FROM good UNION SELECT path FROM way),
 gone AS (SELECT e.path AS path, max(r.at) AS at FROM every e JOIN rem r ON e.path = r.path OR starts_with(e.path, r.path || '/') GROUP BY e.path),
 self AS (SELECT path, max(usn) AS at, arg_max({{'d': is_dir, 's': size}}, usn * 2 + CAST(is_dir AS INTEGER)) AS v FROM good GROUP BY path),
 on_way AS (SELECT path, max(usn) AS at FROM way GROUP BY path)
SELECT e.path AS path, CASE WHEN s.at >= coalesce(g.at, s.at) THEN s.v.d WHEN g.at IS NULL THEN coalesce(b.is_dir, true) ELSE true END AS is_dir,
  CAST(CASE WHEN s.at >= coalesce(g.at, s.at) THEN s.v.s WHEN g.at IS NULL THEN coalesce(b.size, 0) ELSE 0 END AS BIGINT) AS size
FROM every e LEFT JOIN gone g ON g.path = e.path LEFT JOIN self s ON s.path = e.path LEFT JOIN on_way w ON w.path = e.path LEFT JOIN base b ON b.path = e.path
WHERE coalesce(s.at >= coalesce(g.at, s.at), false) OR coalesce(w.at >= coalesce(g.at, w.at), false) OR (b.path IS NOT NULL AND g.at IS NULL)""")
def cdc_path_apply(spark, sf_dir):
    """A journal over the pages' paths that removes files, folders and hosts, makes folders again with what is listed in
    them, adds below files, and adds what a rule excludes."""
    from quarry.operators.exclusions import ExclusionRules, excluded_rows

    pages = catalog.page_paths(spark, sf_dir)
    base = pages.select("path").distinct().select("path", F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("size"))
    n = pages.count()
    j = catalog.journal(spark, sf_dir).where("usn % 9 <> 1 or usn % 45 = 1").select("usn", (F.col("usn") % 9).alias("k"), (F.col("id") % n).alias("page_id"))
    met = j.join(pages.select("page_id", "path", "host", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")), "page_id")
    k = F.col("k")
    path = F.when(k.isin(0, 2), F.col("folder")).when(k == 1, F.col("host")).when(k.isin(3, 4), F.concat("path", F.lit("/new/"), (F.col("usn") % 3).cast("string"))).when(k == 5, F.concat("folder", F.lit("/tmp"))).when(k == 8, F.concat("path", F.lit("/tmp"))).otherwise(F.col("path"))
    changes = met.select("usn", path.alias("path"), (k == 2).alias("is_dir"), F.when(k.isin(0, 1, 6), "remove").otherwise("add").alias("action"), (F.col("usn") % 1000).cast("long").alias("size"))
    listing = pages.where("page_id % 2 = 0").select("path", F.lit(False).alias("is_dir"), F.lit(2).cast("long").alias("size"))
    rules = ExclusionRules.of(spark, globs=("tmp",))
    return M.apply_path_changes(base, changes, lambda rows: excluded_rows(rows, rules).where("excluded"), listing)


_SESSIONS = """SELECT id, max(usn) AS usn, count(*) AS n, max(ts) AS last_ts FROM (SELECT id, usn, ts, sum(fresh) OVER (PARTITION BY id ORDER BY ts, usn) AS s FROM (
 SELECT id, usn, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY id ORDER BY ts, usn) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM journal)) GROUP BY id, s"""


@query(f"SELECT id, usn, n FROM ({_SESSIONS})")
def stream_debounce(spark, sf_dir):
    """Batch twin of the debounced stream: quiet periods part sessions."""
    return M.sessions(catalog.journal(spark, sf_dir), "id", "6 HOUR").drop("session")


@query(f"SELECT id, usn, n FROM ({_SESSIONS}) WHERE last_ts + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM journal)")
def stream_debounce_live(spark, sf_dir):
    """The debounced stream itself: the sessions that its watermark has closed when the journal ends."""
    from quarry.streaming import journal as J

    schema = catalog.table(spark, sf_dir, "events").schema
    changes = J.tail(spark, sf_dir, schema, "events*.parquet").select(F.col("event_id").alias("usn"), F.col("user_id").alias("id"), "ts")
    folder = Snapshots(spark).folder
    J.run_to_table(J.debounced(changes, "6 hours", "1 hour").select("id", "usn", "n"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema("id long, usn long, n long").parquet(f"{folder}/out")


_HEADERS = "SELECT 'S' || s_suppkey AS source_key, s_suppkey % 3 AS journal_id, s_suppkey * 37 % 400 AS next_usn FROM supplier"


@query(f"SELECT source_key, journal_id, next_usn, CASE WHEN journal_id = 1 AND next_usn >= 100 AND next_usn <= 300 AND source_key <> 'S4' THEN 'resume' ELSE 'rebuild' END AS state FROM ({_HEADERS})")
def cdc_offsets(spark, sf_dir):
    """Stored offsets against their journals, each of which has id 1 and holds 100 to 300; one source has none."""
    key = F.col("s_suppkey")
    headers = catalog.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), key.cast("string")).alias("source_key"), (key % 3).alias("journal_id"), (key * 37 % 400).alias("next_usn"))
    journal = headers.where("source_key <> 'S4'").select("source_key", F.lit(1).alias("journal_id"), F.lit(100).alias("first_usn"), F.lit(300).alias("next_usn"))
    return M.offset_state(headers, journal)


@query("SELECT event_id AS usn, user_id AS id, event_type FROM events")
def stream_journal_tail(spark, sf_dir):
    """The journal read as a stream of files into a table."""
    from quarry.streaming import journal as J

    schema = catalog.table(spark, sf_dir, "events").schema
    events = J.tail(spark, sf_dir, schema, "events*.parquet").select(F.col("event_id").alias("usn"), F.col("user_id").alias("id"), "event_type")
    folder = Snapshots(spark).folder
    J.run_to_table(events, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_distinct FROM events")
def stream_resume(spark, sf_dir):
    """Run twice from one checkpoint: nothing is read twice."""
    from quarry.streaming import journal as J

    schema = catalog.table(spark, sf_dir, "events").schema
    folder = Snapshots(spark).folder
    for _ in range(2):
        J.run_to_table(J.tail(spark, sf_dir, schema, "events*.parquet").select("event_id"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_distinct"))


#: Offsets in a file of a journal that streams read, and so records of a trigger.
RECORDS = 1 << 20


def _journal_in_parts(changes, folder, least=4):
    """Grows a journal in the order of its offsets: files of RECORDS of them at most, `least` at least, one after another, as
    often as next() is called. The changes are dealt by offset in one job, so that each file reads its own records alone."""
    spark, whole = changes.sparkSession, f"{folder}-parts"
    last = changes.agg(F.max("usn")).first()[0] or 0
    width = min(RECORDS, -(-(last + 1) // least))
    changes.withColumn("part", F.floor(F.col("usn") / width)).write.partitionBy("part").parquet(whole)
    dealt = spark.read.schema(changes.withColumn("part", F.lit(0).cast("long")).schema).parquet(whole)
    for k in range(last // width + 1):
        dealt.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(folder)
        yield k, last // width + 1


@query(_COMPACT)
def stream_compact(spark, sf_dir):
    """Micro-batches kept as deltas by bucket; some are compacted when the threshold is reached, the rest is merged when the
    store is read. Ends at the result of the batch compaction."""
    from quarry.operators.buckets import BucketStore
    from quarry.streaming import journal as J

    folder = Snapshots(spark).folder
    changes = _changes(spark, sf_dir)
    for _ in _journal_in_parts(changes, f"{folder}/journal"):
        pass
    stream = J.tail(spark, f"{folder}/journal", changes.schema, per_trigger=1)
    keeper = J.Compactor(_links(spark, sf_dir), BucketStore(spark, f"{folder}/store"), threshold=changes.count() // 2, buckets=4)
    keeper.run(stream, f"{folder}/checkpoint").awaitTermination()
    return keeper.store.read().select("id", "parent_id", "name", "size")


@query(_COMPACT)
def stream_live_view(spark, sf_dir):
    """Links and metadata in the state store, in two starts from one checkpoint or more: while one runs the journal grows, and
    the next goes on with what has come. Ends at the result of the compaction."""
    from quarry.streaming import journal as J
    from quarry.streaming import live

    folder = Snapshots(spark).folder
    changes = _changes(spark, sf_dir, "ts")
    span = changes.agg(F.max("ts").cast("long") - F.min("ts").cast("long")).first()[0] or 0
    width = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    running = None
    for k, n in _journal_in_parts(changes, f"{folder}/journal", 2):
        if running is None or not running.isActive or k + 1 == n:
            if running is not None:
                running.awaitTermination()
            stream = J.tail(spark, f"{folder}/journal", changes.schema, per_trigger=1)
            states = live.live_states(stream, 6 * 3_600_000, f"{span + 1} seconds")  # offsets order the records; none is late, whatever its time
            running = live.keep_states(states, f"{folder}/states", f"{folder}/checkpoint", width)
    running.awaitTermination()
    return live.view(_links(spark, sf_dir), spark, f"{folder}/states").select("id", "parent_id", "name", "size")
