"""Joins of catalog rows with their parents, children, paths and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The node that rows without a known parent hang below.
ROOT_ID = 1


def with_parent(nodes: DataFrame) -> DataFrame:
    """Rows with the name of their parent; tops have none and are left out."""
    up = nodes.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return nodes.where("id <> parent_id").join(up, "parent_id")


def adopted(nodes: DataFrame, root: int = ROOT_ID) -> DataFrame:
    """(id, parent): rows whose parent isn't there hang below the root until it comes."""
    known = nodes.select(F.col("id").alias("parent_id"), F.col("id").alias("parent"))
    return nodes.join(known, "parent_id", "left").select("id", F.coalesce("parent", F.lit(root)).alias("parent"))


def children_of(nodes: DataFrame, directory: Column) -> DataFrame:
    """Children of the directories that a predicate picks."""
    picked = nodes.where(directory).select(F.col("id").alias("parent_id"))
    return nodes.where("id <> parent_id").join(picked, "parent_id", "left_semi")


def with_metadata(rows: DataFrame, wanted: DataFrame, path_col: str = "path") -> DataFrame:
    """The rows of a batch of paths, case aside; a path asked for twice gives its rows once."""
    asked = wanted.select(F.lower(path_col).alias("_path")).distinct()
    return rows.withColumn("_path", F.lower(path_col)).join(asked, "_path", "left_semi").drop("_path")


def prefixes(path: Column) -> Column:
    """A path and all above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def with_source(rows: DataFrame, sources: DataFrame, path_col: str = "path") -> DataFrame:
    """(row columns, source): the longest source that is a prefix at a separator; an equi-join on each row's few prefixes,
    not a theta join. Told once for each distinct path, so rows that repeat all stay. Rows without one are left out."""
    each = rows.select(F.col(path_col).alias("_path")).distinct().withColumn("source", F.explode(prefixes(F.col("_path")))).join(sources.select("source").distinct(), "source", "left_semi")
    told = each.groupBy("_path").agg(F.max_by("source", F.length("source")).alias("source"))
    return rows.join(told, F.col(path_col) == F.col("_path")).drop("_path")


def last_used(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Rows with the time of their last use (id, at), or the largest number where they have none."""
    latest = history.groupBy("id").agg(F.max("at").alias("last_at"))
    return rows.join(latest, "id", "left").withColumn("last_at", F.coalesce("last_at", F.lit((1 << 63) - 1)))


def items(shortcuts: DataFrame, apps: DataFrame) -> DataFrame:
    """(id, name, kind) of an item catalog: apps, and shortcuts (id, name, target) of which the first of each target within
    a name stays, unless an app bears the name, case aside."""
    once = shortcuts.groupBy("name", "target").agg(F.min("id").alias("id"))
    named = apps.select(F.lower("name").alias("_name")).distinct()
    others = once.withColumn("_name", F.lower("name")).join(named, "_name", "left_anti")
    return apps.select("id", "name", F.lit("app").alias("kind")).unionByName(others.select("id", "name", F.lit("shortcut").alias("kind")))


def bookmarks(marks: DataFrame, places: DataFrame) -> DataFrame:
    """Bookmarks (place, title) with their place's title where they have none of their own; those of unknown places are left
    out, a place may have many."""
    met = marks.join(places.select("place", F.col("title").alias("_title")), "place")
    return met.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "_title")).drop("_title")
