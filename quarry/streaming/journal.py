"""Structured Streaming over the change journal: tail, resume, debounce, compaction on a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.buckets import BUCKETS, BucketStore


def tail(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", per_trigger: int = 16) -> DataFrame:
    """Unbounded read of journal files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", glob).parquet(folder)


def debounced(changes: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Changes of an id closer than the gap fold to one session, emitted when the watermark has passed it."""
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("id", F.session_window("ts", gap).alias("s")).agg(F.max("usn").alias("usn"), F.count("*").alias("n"))


class Compactor:
    """Micro-batches are appended to a bucket store as deltas, and compacted once `threshold` changes are pending, so that a
    batch costs its own size and a compaction that of the buckets that changed. Batches bear their numbers: one that is run
    again after a failure rewrites what it had written, and nothing is applied twice."""

    def __init__(self, base: DataFrame, store: BucketStore, threshold: int = 1_000_000, buckets: int = BUCKETS):
        self.store, self.threshold = store, threshold
        if not store.manifest():
            store.create(base, buckets)

    def step(self, batch: DataFrame, number: int) -> None:
        if self.store.append(batch, number) and self.store.n_pending() >= self.threshold:
            self.store.compact()

    def run(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        return changes.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs what is available now into Parquet; started again from the same checkpoint it goes on after it."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
