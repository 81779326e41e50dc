"""Change-data maintenance: journal dispatch, links, metadata overlay, compaction, offsets.

Two things follow from a journal and are kept apart. Membership: which links (rows by their key) are there; only add,
remove, hide and toggle records touch it. Metadata: sizes and times of an id, which the last refreshing record gives to
every row of the id that no later record has made; it never adds or removes a row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quarry.functions.instant import normal_path
from quarry.operators import tree
from quarry.operators.joins import prefixes
from quarry.operators.storage import cut_lineage
from quarry.sources import catalog as C

LINK = ("id", "parent_id", "name")
#: Reasons after which an id is looked at again, unless it is deleted.
REFRESHING = C.FILE_CREATE | C.RENAME_NEW | C.DATA_OVERWRITE | C.DATA_EXTEND | C.DATA_TRUNCATION | C.BASIC_INFO | C.COMPRESSION | C.ENCRYPTION


def _has(reason: Column, bits: int) -> Column:
    return reason.bitwiseAND(F.lit(bits)) != 0


def reason_action(reason: Column, *, toggle: str = "toggle") -> Column:
    """Ordered dispatch of a change record; refresh stands for records that touch metadata alone."""
    return (
        F.when(_has(reason, C.HARD_LINK) & ~_has(reason, C.FILE_CREATE | C.FILE_DELETE), toggle)
        .when(_has(reason, C.RENAME_OLD), "hide")
        .when(_has(reason, C.FILE_DELETE), "remove")
        .when(_has(reason, C.FILE_CREATE | C.RENAME_NEW), "add")
        .when(refreshes(reason), "refresh")
        .otherwise("skip")
    )


def refreshes(reason: Column) -> Column:
    return _has(reason, REFRESHING) & ~_has(reason, C.FILE_DELETE)


def last_by(changes: DataFrame, *key: str, order: str = "usn") -> DataFrame:
    """The last change of each key; pre-aggregated, so a hot key costs each task one row."""
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(*key, "s.*")


def _equal(left: str, right: str, key: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in key))


def link_states(changes: DataFrame, key: tuple[str, ...] = LINK) -> DataFrame:
    """What a journal makes of each key it touches: `settled` is true or false after the last add, remove or hide, null if
    only toggles speak; `flips` says whether toggles after that are odd in number. Both are sums over the records."""
    own = changes.where(F.col("action").isin("add", "remove", "hide", "toggle"))
    sets = F.col("action") != "toggle"
    settled = own.where(sets).groupBy(*key).agg(F.max("usn").alias("at"), F.max_by("action", "usn").alias("last"))
    toggles = own.where(~sets).select(*key, "usn")
    later = toggles.alias("t").join(settled.alias("s"), _equal("t", "s", key), "left").where("s.at is null or t.usn > s.at")
    flips = later.groupBy(*(F.col(f"t.{k}").alias(k) for k in key)).agg((F.count("*") % 2 == 1).alias("flips"))
    both = settled.alias("s").join(flips.alias("f"), _equal("s", "f", key), "full")
    return both.select(*(F.coalesce(f"s.{k}", f"f.{k}").alias(k) for k in key), F.when(F.col("last").isNotNull(), F.col("last") == "add").alias("settled"), "last", F.coalesce("flips", F.lit(False)).alias("flips"))


def apply_links(base: DataFrame, changes: DataFrame, key: tuple[str, ...] = LINK) -> DataFrame:
    """Base with the journal's links: rows whose key no change names stay, a row that is there keeps its columns, a new
    one has those of its last add or toggle, as far as the journal has them."""
    return apply_states(base, link_states(changes, key), makers_of(changes, key), key)


def makers_of(changes: DataFrame, key: tuple[str, ...] = LINK) -> DataFrame:
    """The last add or toggle of each link."""
    return last_by(changes.where(F.col("action").isin("add", "toggle")), *key)


def overlay_latest(rows: DataFrame, makers: DataFrame, refreshed: DataFrame, key: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Rows with metadata of the latest record that tells any: the last that refreshed their id (id, usn, columns) or the last
    add or toggle of their link (key, usn, columns), whichever is later. So steps of a journal come to what the whole does."""
    made = makers.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("usn").alias("_made"), F.struct(*columns).alias("_first"))
    told = refreshed.select(F.col("id").alias("_rid"), F.col("usn").alias("_told"), F.struct(*columns).alias("_then"))
    met = rows.join(made, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key)), "left").join(told, F.col("id") == F.col("_rid"), "left")
    told_last = F.coalesce(F.col("_told") >= F.coalesce("_made", F.col("_told")), F.lit(False))
    now = lambda c: F.when(told_last, F.col(f"_then.{c}")).when(F.col("_made").isNotNull(), F.col(f"_first.{c}")).otherwise(F.col(c)).alias(c)
    return met.select(*(now(c) if c in columns else F.col(c) for c in rows.columns))


def apply_states(base: DataFrame, states: DataFrame, makers: DataFrame, key: tuple[str, ...] = LINK) -> DataFrame:
    """Base with links in the states that link_states() tells; makers has the columns of a new one, by its key."""
    there = F.col("settled")
    old = base.alias("b").join(states.alias("l"), _equal("b", "l", key), "left")
    kept = old.where(F.coalesce(there, F.lit(True)) != F.coalesce("flips", F.lit(False))).select("b.*")
    fresh = states.where(F.coalesce(there, F.lit(False)) != F.col("flips")).select(*key)
    fresh = fresh.alias("n").join(base.select(*key).alias("o"), _equal("n", "o", key), "left_anti")
    made = fresh.alias("n").join(makers.alias("m"), _equal("n", "m", key))
    return kept.unionByName(made.select(*(F.col(f"n.{c}") if c in key else F.col(f"m.{c}") if c in makers.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns)))


def overlay_metadata(rows: DataFrame, changes: DataFrame, columns: tuple[str, ...] = ("size",), id_col: str = "id") -> DataFrame:
    """Rows whose id a record refreshed have what the last such record says; changes carry `refresh` (boolean)."""
    last = changes.where("refresh").groupBy(F.col(id_col).alias("_id")).agg(F.max_by(F.struct(*columns), "usn").alias("_new"))
    met = rows.join(last, F.col(id_col) == F.col("_id"), "left")
    return met.select(*(F.when(F.col("_id").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def compact(base: DataFrame, changes: DataFrame, key: tuple[str, ...] = LINK, columns: tuple[str, ...] = ("size",), directories: bool = False) -> DataFrame:
    """A new base from a base and a journal of changes (key, usn, action, refresh and metadata columns).

    With directories, what lies below a removed one goes too, over the parentage that the journal leaves: what was moved
    out stays, what was moved in goes, and a hidden (renamed) one takes nothing along."""
    refreshed = last_by(changes.where("refresh").select("id", "usn", *columns), "id")
    rows = overlay_latest(apply_links(base, changes, key), makers_of(changes.select(*key, "usn", "action", *columns), key), refreshed, key, columns)
    if not directories:
        return rows
    rows = cut_lineage(rows)
    gone = link_states(changes, key).where("last = 'remove'").select("id").distinct().join(rows.select("id"), "id", "left_anti")
    heads = cut_lineage(rows.join(gone.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("id").distinct())
    if heads.isEmpty():
        return rows
    return rows.join(tree.cascade(rows, heads), "id", "left_anti").select(rows.columns)


def toggled(links: DataFrame, toggles: DataFrame, *key: str) -> DataFrame:
    """Links after an odd number of toggles of each key are flipped."""
    odd = toggles.groupBy(*key).agg((F.count("*") % 2).alias("odd")).where("odd = 1").drop("odd")
    return links.join(odd, list(key), "left_anti").unionByName(odd.join(links.select(*key), list(key), "left_anti"))


def apply_path_changes(base: DataFrame, changes: DataFrame, excluded: Callable[[DataFrame], DataFrame] | None = None, listing: DataFrame | None = None) -> DataFrame:
    """Base after path-keyed changes, in their order. Columns: path, is_dir, size; changes also action and usn.

    `add` (create, change, the new name of a rename) puts a path there and what is missing above it, as directories of size
    0; an added directory brings along what the listing (path, is_dir, size) has below it. `remove` (delete, the old name
    of a rename) takes a path and all that is below it at that time. excluded: takes rows with a path and returns those
    that an exclusion rule excludes; adding such a path removes it.

    A path is there if it was added, itself or as the way to another, since the last removal of it or of any directory
    above it; of a record's two at the same usn the removal comes first. It is what it was when it was last added itself,
    if that is since that removal; else what it was in the base, if nothing above was removed; else a directory made on the
    way. Of repeated paths in the base or the listing one is kept, the directory or larger. A null path is left out.

    Of a path's records only the last of each sort counts, as does the last listing of a directory: the journal is brought
    down to these first, so no row is made for a record and what its directory holds. Removals meet paths by the few
    prefixes of each, not by comparison of all with all, and every path is dealt once."""
    clean = lambda df: df.withColumn("path", normal_path(F.col("path"))).where("path is not null and path <> ''")
    last = changes.groupBy("path", "is_dir", "action").agg(F.max(F.struct("usn", "size")).alias("s"))
    old, own = clean(base.select("path", "is_dir", "size")), cut_lineage(clean(last.select("path", "is_dir", "s.size", "action", "s.usn")))
    adds = own.where("action = 'add'").select("path", "usn", "is_dir", F.when(F.col("is_dir"), F.lit(0)).otherwise(F.col("size")).cast("long").alias("size"))
    if listing is not None:
        dirs = adds.where("is_dir")
        if excluded is not None:  # an excluded directory isn't listed
            dirs = dirs.join(excluded(dirs.select("path").distinct()).select("path").distinct(), "path", "left_anti")
        opened = dirs.groupBy(F.col("path").alias("up")).agg(F.max("usn").alias("usn"))
        inside = clean(listing.select("path", "is_dir", "size")).withColumn("up", F.explode(_above("path"))).join(opened, "up")
        brought = inside.select("path", "usn", "is_dir", F.when(F.col("is_dir"), F.lit(0)).otherwise(F.col("size")).cast("long").alias("size"))
        adds = cut_lineage(adds.unionByName(brought))
    gone = own.where("action = 'remove'").select("path", "usn")
    if excluded is not None:
        out = excluded(adds.select("path").distinct()).select("path").distinct()
        gone = gone.unionByName(adds.join(out, "path", "left_semi").select("path", "usn"))
        adds = adds.join(out, "path", "left_anti")
    removed = gone.groupBy(F.col("path").alias("up")).agg(F.max("usn").alias("removed"))
    added = cut_lineage(adds.groupBy("path").agg(F.max("usn").alias("added"), F.max_by(F.struct("is_dir", "size"), F.struct("usn", "is_dir", "size")).alias("new")))
    ways = added.select(F.explode(_above("path")).alias("path"), F.col("added").alias("way")).groupBy("path").agg(F.max("way").alias("way"))
    paths = old.select("path").unionByName(added.select("path")).unionByName(ways.select("path"))
    swept = paths.select("path", F.explode(prefixes(F.col("path"))).alias("up")).join(removed, "up").groupBy("path").agg(F.max("removed").alias("removed"))
    part = lambda df, *has: df.select(*(F.col(c) if c in has else F.lit(None).cast(t).alias(c) for c, t in _PATH_STATE))
    every = part(old.select("path", F.struct("is_dir", F.col("size").cast("long").alias("size")).alias("old")), "path", "old").unionByName(part(added, "path", "added", "new")).unionByName(part(ways, "path", "way")).unionByName(part(swept, "path", "removed"))
    state = every.groupBy("path").agg(*(F.max(c).alias(c) for c, _ in _PATH_STATE if c != "path"))
    since = lambda c: F.col(c) >= F.coalesce("removed", F.col(c))
    there = F.coalesce(since("added"), F.lit(False)) | F.coalesce(since("way"), F.lit(False)) | (F.col("old").isNotNull() & F.col("removed").isNull())
    made = F.struct(F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"))
    now = F.when(since("added"), F.col("new")).when(F.col("removed").isNull(), F.coalesce("old", made)).otherwise(made)
    return state.where(there).select("path", now["is_dir"].alias("is_dir"), now["size"].alias("size"))


#: What is known of a path: its row in the base, when it was last added and as what, when it was last on the way to an added
#: path, when it or a directory above it was last removed.
_PATH_STATE = (("path", "string"), ("old", "struct<is_dir: boolean, size: bigint>"), ("added", "bigint"), ("new", "struct<is_dir: boolean, size: bigint>"), ("way", "bigint"), ("removed", "bigint"))


def _above(path: str) -> Column:
    """The directories above a path."""
    every = prefixes(F.col(path))
    return F.slice(every, F.lit(1), F.size(every) - 1)


def diff(old: DataFrame, new: DataFrame, compare: tuple[str, ...], id_col: str = "id") -> DataFrame:
    """(id, status): added, removed, reused (all compared columns equal) or changed, from two scans."""
    state = lambda side, df: df.select(id_col, F.struct(*compare).alias(side))
    both = state("was", old).join(state("now", new), id_col, "full")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "reused").otherwise("changed")
    return both.select(id_col, status.alias("status"))


def sessions(changes: DataFrame, key: str, gap: str) -> DataFrame:
    """Debounce in batch form: changes of a key closer than the gap fold to one, its last. Sessions merge as partial
    aggregates, so a hot key is no single window."""
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy(key, F.session_window("ts", gap).alias("session")).agg(F.max("usn").alias("usn"), F.count("*").alias("n"))


def offset_state(headers: DataFrame, journal: DataFrame) -> DataFrame:
    """What to do with each stored snapshot header (source_key, journal_id, next_usn) given its journal (source_key,
    journal_id, first_usn, next_usn): resume after its offset, or rebuild if the journal is another one, no longer holds
    the offset or isn't yet there. A source without a journal is rebuilt."""
    of = journal.select("source_key", F.col("journal_id").alias("_id"), F.col("first_usn").alias("_first"), F.col("next_usn").alias("_next"))
    met = headers.join(of, "source_key", "left")
    fine = (F.col("journal_id") == F.col("_id")) & F.col("next_usn").between(F.col("_first"), F.col("_next"))
    return met.select(*headers.columns, F.when(fine, "resume").otherwise("rebuild").alias("state"))


def catch_up(base: DataFrame, changes: DataFrame, header: tuple[int, int], journal: tuple[int, int, int], rescan: DataFrame, key: tuple[str, ...] = LINK) -> DataFrame:
    """Base after the changes since its header's (journal id, next usn); the rescan, if (journal id, first usn, next usn) says
    that changes are missing."""
    if header[0] != journal[0] or not journal[1] <= header[1] <= journal[2]:
        return rescan
    return compact(base, changes.where(F.col("usn") >= header[1]), key)


def journal_since(journal: DataFrame, header: Row, journal_id: int) -> DataFrame:
    """The records that a snapshot with this header (journal_id, next_usn) lacks, each with the offset to store next. Raises
    if the header is of another journal, or the journal has dropped records before it: then the source is scanned anew."""
    if header["journal_id"] != journal_id:
        raise LookupError(f"the header is of journal {header['journal_id']}, not of {journal_id}")
    held = journal.agg(F.min("usn").alias("first"), (F.max("usn") + 1).alias("next")).first()
    if held["first"] is not None and not held["first"] <= header["next_usn"] <= held["next"]:
        raise LookupError(f"the journal holds {held['first']} to {held['next']}, not {header['next_usn']}")
    return journal.where(F.col("usn") >= header["next_usn"]).withColumn("next_usn", F.lit(held["next"]))
