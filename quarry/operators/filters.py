"""Row and scope filters as columns and DataFrame transforms."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.catalog import HIDDEN, SYSTEM

MIB = 1 << 20


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def all_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def has_flag(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(bits)) != 0


def visible(flags: Column) -> Column:
    return ~has_flag(flags, HIDDEN | SYSTEM)


def on_drive(rows: DataFrame, drive: str | None) -> DataFrame:
    """Rows of the source that a drive word names; all without one."""
    return rows if drive is None else rows.where(F.lower("source_key") == drive.lower())


def down_to(rows: DataFrame, depth: int) -> DataFrame:
    return rows.where(F.col("depth") <= depth)


def modified_since(rows: DataFrame, moment: Column) -> DataFrame:
    """Rows changed at or after a moment; those without a time aren't."""
    return rows.where(F.col("modified") >= moment)


def size_bucket(size: Column, bucket: str) -> Column:
    return {"small": size < MIB, "medium": size.between(MIB, 100 * MIB), "large": size > 100 * MIB}[bucket]


def tier(text: Column, exact: str) -> Column:
    """0 starts with, 1 holds as a word start, 2 holds, 3 holds in order; null: drop."""
    low = F.lower(text)
    fuzzy = "^" + "".join(f"[^{c}]*{c}" for c in exact)
    return F.when(low.startswith(exact), 0).when(low.contains(f"#{exact}"), 1).when(low.contains(exact), 2).when(low.rlike(fuzzy), 3)


def live_rows(rows: DataFrame, superseded: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(superseded.select(key), key, "left_anti")
