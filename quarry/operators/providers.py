"""Directories that providers register, and what the catalog and the journal say of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.globs import pattern_list
from quarry.functions.instant import normal_path
from quarry.operators.exclusions import parent_of
from quarry.operators.joins import prefixes


@dataclass
class DirectoryRegistry:
    """(owner, directory, recursive, pattern) registrations. An owner's directories may lie in one another: a row is then told
    once for the owner. Directories are few and written down on the driver; rows meet them by the few prefixes of each."""

    registered: list[tuple[str, str, bool, str]] = field(default_factory=list)

    def register(self, owner: str, directory: str, recursive: bool = True, pattern: str = "*") -> None:
        self.registered.append((owner, directory.replace("\\", "/").rstrip("/").lower(), recursive, f"(?i){pattern_list(pattern)}"))

    def unregister(self, owner: str) -> None:
        self.registered = [r for r in self.registered if r[0] != owner]

    def owners_of(self, rows: DataFrame, path_col: str = "path") -> DataFrame:
        """(path, owner) of the distinct paths of rows."""
        paths = rows.select(F.col(path_col).alias("_path")).where("_path is not null").distinct()
        own = F.lower(normal_path(F.col("_path")))
        each = paths.withColumn("directory", F.explode(prefixes(parent_of(own)))).withColumn("_direct", F.col("directory") == parent_of(own))
        known = rows.sparkSession.createDataFrame(self.registered, "owner string, directory string, recursive boolean, regex string")
        met = each.join(known, "directory").where((F.col("recursive") | F.col("_direct")) & F.rlike(F.substring_index(normal_path(F.col("_path")), "/", -1), F.col("regex")))
        return met.select("_path", "owner").distinct()

    def listed(self, rows: DataFrame, path_col: str = "path") -> DataFrame:
        """Rows below registered directories with their owner; rows that repeat each stay."""
        return rows.join(self.owners_of(rows, path_col), F.col(path_col) == F.col("_path")).select("owner", *rows.columns)

    def search(self, rows: DataFrame, owner: str, text: str, path_col: str = "path") -> DataFrame:
        """An owner's rows whose name holds the text, case aside."""
        name = F.substring_index(normal_path(F.col(path_col)), "/", -1)
        return self.listed(rows, path_col).where((F.col("owner") == owner) & F.contains(F.lower(name), F.lit(text.lower()))).drop("owner")

    def changed(self, changes: DataFrame, path_col: str = "path") -> DataFrame:
        """(owner, changes): whose directories a journal of path changes touches, and how often."""
        return self.listed(changes.select(path_col), path_col).groupBy("owner").agg(F.count("*").alias("changes"))
