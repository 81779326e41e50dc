"""Shared folders: lineage cuts, and versioned snapshots with a header that is read alone."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one, but only on a local
    master: on a cluster each executor would write to its own disk."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Snapshots:
    """Snapshot versions in a shared folder; a version counts once its header is there, which is written last."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"

    def _path(self, version: str, part: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{version}/{part}".rstrip("/"))

    def _fs(self):
        return self._path("", "").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, rows: DataFrame, version: str | None = None, journal_id: int = 0, next_usn: int = 0, dictionary: Callable[[DataFrame], DataFrame] | None = None) -> str:
        """Rows sorted by id within their partition, by source; a name dictionary if one is asked for; then the header:
        counts, id range, journal and offset."""
        version = version or uuid.uuid4().hex
        rows.sortWithinPartitions("id").write.mode("overwrite").partitionBy("source_key").parquet(f"{self.folder}/{version}/rows")
        kept = self.spark.read.parquet(f"{self.folder}/{version}/rows")
        if dictionary:
            dictionary(kept).write.mode("overwrite").parquet(f"{self.folder}/{version}/names")
        head = kept.agg(F.count("*").alias("n_rows"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))
        head.select("*", F.lit(journal_id).cast("long").alias("journal_id"), F.lit(next_usn).cast("long").alias("next_usn")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{version}/header")
        return version

    def read(self, version: str) -> DataFrame:
        """Opens a version; nothing is read before it is used."""
        return self.spark.read.parquet(f"{self.folder}/{version}/rows")

    def dictionary(self, version: str) -> DataFrame:
        """The version's distinct names with their masks, if it was written with them."""
        return self.spark.read.parquet(f"{self.folder}/{version}/names")

    def header(self, version: str) -> DataFrame:
        """One row of counts and offsets; the rows aren't touched."""
        return self.spark.read.parquet(f"{self.folder}/{version}/header")

    def has(self, version: str) -> bool:
        return self._fs().exists(self._path(version, "header/_SUCCESS"))

    def drop(self, version: str) -> None:
        self._fs().delete(self._path(version, ""), True)

    def names(self) -> list[str]:
        folder = self._path("", "")
        return sorted(s.getPath().getName() for s in self._fs().listStatus(folder)) if self._fs().exists(folder) else []
