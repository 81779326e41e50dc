"""Trees of any depth over parent ids: paths, ancestors, cascades.

Ancestors are found by doubling: each round a directory's way up is joined with that of the one it has reached, so a tree
of depth d takes log2(d) rounds, whatever its shape. Directories that have arrived at the top take no part in further
joins, and leaves in none but that with their parent. Scopes and cascades are ranges of directory numbers.

Defined results: a node whose parent is unknown hangs below the top. Nodes on a ring of parents, or below one, never
arrive; they have no path, and their ancestors are those met once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ranking import placed
from quarry.operators.storage import cut_lineage

#: Rounds after which a tree is deeper than any table has rows.
MAX_ROUNDS = 64


def _is_top(root: int | None) -> Column:
    return F.coalesce(F.col("id") == F.col("parent_id"), F.lit(False)) | (F.col("id") == F.lit(root) if root is not None else F.lit(False))


def ways_up(nodes: DataFrame, root: int | None = None, name: str = "name") -> DataFrame:
    """(id, names, ancestors, ring): names from the top to the node, ids from the top's child's parent down to the node's.

    The top itself (a node that is its own parent, or `root`) is left out."""
    edges = nodes.where(~_is_top(root)).select("id", F.col("parent_id").alias("jump"), F.coalesce(name, F.lit("")).alias("name"))
    tops = nodes.where(_is_top(root)).select(F.col("id").alias("jump"), F.lit(True).alias("arrived"))
    known = nodes.select(F.col("id").alias("jump"), F.lit(True).alias("known"))
    start = edges.join(known.distinct(), "jump", "left").join(tops.distinct(), "jump", "left")
    done = F.coalesce("arrived", F.lit(False)) | F.col("known").isNull()
    state = cut_lineage(start.select("id", "jump", F.array("name").alias("names"), F.when(F.col("known").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("jump")).alias("ancestors"), done.alias("done"), F.lit(False).alias("ring")))
    for _ in range(MAX_ROUNDS):
        open_ = state.where("not done")
        if open_.isEmpty():
            return state.select("id", "names", "ancestors", "ring")
        above = state.select(F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("names").alias("up"), F.col("ancestors").alias("over"), F.col("done").alias("up_done"), F.col("ring").alias("up_ring"))
        met = open_.join(above, "jump")
        round_ = F.col("up_ring") | F.arrays_overlap("over", F.array("id")) | F.arrays_overlap("over", "ancestors") | (F.col("far") == F.col("id"))
        moved = met.select("id", F.col("far").alias("jump"), F.concat("up", "names").alias("names"), F.array_distinct(F.concat("over", "ancestors")).alias("ancestors"), (F.col("up_done") | round_).alias("done"), round_.alias("ring"))
        state = cut_lineage(state.where("done").unionByName(moved))
    raise RuntimeError("parents don't come to an end")


def directories(nodes: DataFrame) -> DataFrame:
    """The nodes that have children: all that a way up is made of."""
    return nodes.join(nodes.select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi")


def from_above(nodes: DataFrame, root: int | None = None, name: str = "name") -> DataFrame:
    """Nodes with names (from the top down), ancestors and ring. Only directories take part in the rounds of doubling; each
    node, most of them leaves, then meets the way of its parent once."""
    dirs = cut_lineage(directories(nodes))  # read several times, and few
    own = ways_up(dirs, root, name).select(F.col("id").alias("parent_id"), F.col("names").alias("_names"), F.concat("ancestors", F.array("id")).alias("_ids"), F.col("ring").alias("_ring"))
    tops = dirs.where(_is_top(root)).select(F.col("id").alias("parent_id"), F.array().cast("array<string>").alias("_names"), F.array("id").alias("_ids"), F.lit(False).alias("_ring"))
    met = nodes.where(~_is_top(root)).join(own.unionByName(tops), "parent_id", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    names = F.concat(F.coalesce("_names", none("string")), F.array(F.coalesce(name, F.lit(""))))
    return met.select(*nodes.columns, names.alias("names"), F.array_distinct(F.coalesce("_ids", none("bigint"))).alias("ancestors"), F.coalesce("_ring", F.lit(False)).alias("ring"))


def with_paths(nodes: DataFrame, top: str = "T:", root: int | None = None) -> DataFrame:
    """Nodes with path, depth, parent_path, ancestors and names (from the top down); rings have no path."""
    path = lambda names: F.concat_ws("/", F.lit(top), names)
    clear = lambda c: F.when(~F.col("ring"), c)
    return from_above(nodes, root).select(*nodes.columns, clear(F.size("names")).alias("depth"), clear(path(F.col("names"))).alias("path"), clear(path(F.slice("names", 1, F.greatest(F.size("names") - 1, F.lit(0))))).alias("parent_path"), "ancestors", "names")


def closure(nodes: DataFrame, root: int | None = None) -> DataFrame:
    """(id, ancestor): every node with each node above it."""
    return from_above(nodes, root, "id").select("id", F.explode("ancestors").alias("ancestor"))


def subtree_labels(nodes: DataFrame, root: int | None = None) -> DataFrame:
    """directory_labels() of the nodes that have children."""
    return directory_labels(cut_lineage(directories(nodes).select("id", "parent_id")), root)


def directory_labels(dirs: DataFrame, root: int | None = None) -> DataFrame:
    """(id, first, last) of every directory that isn't on a ring of parents or below one: its number in pre-order, and the
    largest number below it. A directory is inside another if its number is in that one's range, and a row if its
    parent's is; leaves are given no numbers of their own, so most rows need none.

    Pre-order is the order of the ways of ids from the top, so numbers come from one sort of the directories; a range is as
    long as there are directories whose way holds it. Both shuffle directories alone."""
    way = ways_up(dirs.withColumn("_no", F.lit("")), root, "_no").where("not ring").select("id", "ancestors")
    way = way.unionByName(dirs.where(_is_top(root)).select("id", F.array().cast("array<bigint>").alias("ancestors")))
    inside = way.select(F.explode("ancestors").alias("id")).groupBy("id").agg(F.count("*").alias("inside"))
    order = placed(way.select("id", F.concat("ancestors", F.array("id")).alias("way")).orderBy("way"), "first").drop("way")
    return order.join(inside, "id", "left").select("id", "first", (F.col("first") + F.coalesce("inside", F.lit(0))).alias("last"))


def labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes with `within`: the number of the directory they lie in; null for what no labelled directory holds, and for tops.
    Stored in the order of `within`, a scope is a range that the files' statistics tell."""
    met = nodes.join(labels.select(F.col("id").alias("parent_id"), F.col("first").alias("within")), "parent_id", "left")
    return met.select(*nodes.columns, F.when(F.col("id") != F.col("parent_id"), F.col("within")).alias("within"))


def in_scope(rows: DataFrame, labels: DataFrame, directory: int) -> DataFrame:
    """Labelled rows below a directory: a range of numbers, no join."""
    found = labels.where(F.col("id") == directory).select("first", "last").first()
    return rows.limit(0) if found is None else rows.where(F.col("within").between(found["first"], found["last"]))


#: Numbers of directories that are scanned in one group.
STRETCH = 1 << 16


def covered(labels: DataFrame, removed: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(id, first) of the directories at or below removed ones: those at whose number a removed range is still open, that is
    not past the largest end of the ranges begun so far. The running maximum is taken within stretches of numbers and,
    over one row a stretch, across them, so that no task sees all."""
    at = F.floor(F.col("first") / stretch)
    ends = labels.join(removed.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left").select("id", "first", at.alias("_at"), F.when(F.col("_gone"), F.col("last")).alias("_end"))
    whole = ends.groupBy("_at").agg(F.max("_end").alias("_most"))
    before = whole.select("_at", F.max("_most").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    running = F.max("_end").over(Window.partitionBy("_at").orderBy("first").rowsBetween(Window.unboundedPreceding, 0))
    met = ends.withColumn("_end", running).join(before, "_at")
    return met.where(F.greatest("_end", "_before") >= F.col("first")).select("id", "first")


def cascade(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """Ids that go with the removed ones over current parentage, themselves included. Directories go by their numbers; those
    on rings of parents, which have none, by the ids they meet on their way; other nodes with their parent."""
    gone = cut_lineage(removed.select("id").distinct())
    dirs = cut_lineage(directories(nodes).select("id", "parent_id"))
    labels = directory_labels(dirs)
    rings = cut_lineage(dirs.join(labels, "id", "left_anti").select("id"))
    lost = covered(labels, gone).select("id")
    if not rings.isEmpty():
        lost = lost.union(closure(dirs).join(rings, "id", "left_semi").join(gone.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").select("id"))
    below = nodes.where(~_is_top(None)).join(lost.union(gone).distinct().withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("id")
    return below.union(gone).distinct()
