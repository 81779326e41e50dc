"""Counts, dictionaries and fingerprints of a catalog. Everything pre-aggregates, so a hot key costs each task one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources import catalog as C

#: Most distinct values that a fingerprint is made of; they meet in one sorted array.
MAX_VALUES = 100_000


def counts_by(rows: DataFrame, source: Column, is_dir: Column) -> DataFrame:
    """(source, dirs, files)."""
    return rows.groupBy(source.alias("source")).agg(F.count_if(is_dir).alias("dirs"), F.count_if(~is_dir).alias("files"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def live_count(base: DataFrame, journal: DataFrame) -> DataFrame:
    """Count of a base kept up by its journal: one up for a create, one down for a delete, never below nothing."""
    step = F.when(F.col("reason") == C.FILE_CREATE, 1).when(F.col("reason") == C.FILE_DELETE, -1).otherwise(0)
    steps = base.select(F.lit(1).alias("step")).unionByName(journal.select(step.alias("step")))
    return steps.agg(F.greatest(F.coalesce(F.sum("step"), F.lit(0)), F.lit(0)).alias("live"))


def live_counts_by(base: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """(key, live): counts by a key after a journal of signed steps (key, step)."""
    steps = base.select(key, F.lit(1).alias("step")).unionByName(changed.select(key, "step"))
    return steps.groupBy(key).agg(F.greatest(F.sum("step"), F.lit(0)).alias("live"))


def dictionary(rows: DataFrame) -> DataFrame:
    """Distinct names with how many rows bear them."""
    return rows.groupBy("name").agg(F.count("*").alias("n"))


def children(nodes: DataFrame) -> DataFrame:
    """(parent_id, n) of directories that have any; a top is no child of its own."""
    return nodes.where("id <> parent_id").groupBy("parent_id").agg(F.count("*").alias("n"))


def best_by(rows: DataFrame, key: str, score: Column) -> DataFrame:
    """(key, best, first_id): best score over a name's texts, and the first row that bears it."""
    return rows.groupBy(key).agg(F.max(score).alias("best"), F.min("id").alias("first_id"))


def term_mask(rows: DataFrame, key: str, terms: list[Column]) -> DataFrame:
    """(key, mask): bit i is set if term i holds for any row of the key."""
    mask = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(terms)), F.lit(0))
    return rows.groupBy(key).agg(F.bit_or(mask).alias("mask"))


def walk_statistics(rows: DataFrame, url: Column, host: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_if(url.isNull()).alias("skipped"), F.count_if(host == "").alias("errors"), F.countDistinct(host).alias("sources"))


def fingerprint(values: DataFrame, column: str) -> DataFrame:
    """One hash of a set of values: trimmed, distinct, sorted. Fails beyond MAX_VALUES values rather than gather them all."""
    distinct = values.select(F.trim(column).alias("v")).where("v is not null").distinct()
    few = distinct.limit(MAX_VALUES + 1)
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("v")), ";"), 256)
    return few.agg(F.when(F.count("*") > MAX_VALUES, F.raise_error(F.lit(f"more than {MAX_VALUES} values")).cast("string")).otherwise(joined).alias("fingerprint"))
