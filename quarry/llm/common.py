"""Shared plumbing of the training-data operators: shared-folder tables, batch cutting, name checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about this many UTF-8 bytes, so that memory does not follow the batch size.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one, but only on a local
    master: on a cluster each executor would write to its own disk."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, removed by dropped() or when the session ends; options
    are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(where)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = lambda: fs.delete(where, True)
    return found


def dropped(table: DataFrame) -> None:
    """Removes a stored table that nothing reads any more; other DataFrames stay as they are."""
    remove = getattr(table, "_stored_at", None)
    if callable(remove):
        remove()


def unnamed(df: DataFrame) -> DataFrame:
    """df with its columns named by place, so that an operator's own columns clash with none."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def n_buckets(spark: SparkSession, n_bytes: int, target: int) -> int:
    """Buckets of a packed shuffle: as many as the bytes need to be of the target size, four to a shuffle task at least."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // target))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def portions(batches: Iterable[pa.RecordBatch], at: int | str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about limit bytes of the text column at, so that a worker never holds a whole batch as
    Python objects; what is cut isn't copied."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        for a, b in slices(sizes, limit):
            yield batch.slice(a, b - a)


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about limit bytes; a longer row stands alone."""
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
