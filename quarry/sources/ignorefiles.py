"""Ignore files as a source: rules of .ignore, .fdignore and .gitignore files, heard from the top of a tree down."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.globs import folded, ignore_rules
from quarry.operators.exclusions import IGNORE_NAMES, RULES

#: Most bytes of ignore files that are read; they are parsed on the driver.
MAX_BYTES = 16 << 20


def ignore_files(spark: SparkSession, folder: str) -> Iterator[tuple[str, str, str]]:
    """(directory, name, text) of the ignore files below a folder, by Hadoop's file API: Spark's readers leave out names
    that begin with a dot. A file may also be a folder of part files, as Spark writes them."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    above, left = fs.makeQualified(root).toString().rstrip("/"), MAX_BYTES
    files = fs.listFiles(root, True)
    while files.hasNext():
        status = files.next()
        *directory, name = status.getPath().toString()[len(above) + 1 :].split("/")
        if name.startswith("part-") and directory and directory[-1] in IGNORE_NAMES:
            name = directory.pop()
        if name not in IGNORE_NAMES:
            continue
        left -= status.getLen()
        if left < 0:
            raise ValueError(f"ignore files below {folder} hold more than {MAX_BYTES} bytes")
        stream = fs.open(status.getPath())
        try:
            yield "/".join(directory), name, bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()


def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    """(directory, kind, ordinal, regex, keep, dirs_only) of all ignore files below a folder; '' is the folder itself."""
    return rules_frame(spark, ignore_files(spark, folder))


def rules_frame(spark: SparkSession, files: Iterable[tuple[str, str, str]]) -> DataFrame:
    """The rules of (directory, name, text) ignore files."""
    found = [(directory, name, i, r.regex, r.keep, r.dirs_only) for directory, name, text in files for i, r in enumerate(folded(ignore_rules(text)))]
    return spark.createDataFrame(found, RULES)
