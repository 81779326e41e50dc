"""A stored name dictionary with stable ids, laid out for prefix and equality terms.

Names get ids by their place in the order of their folded form when the dictionary is built; names that come later get ids
behind the largest, so an id never changes and is never given twice. Rows keep the id in place of the name, so a search
reads names once, finds ids, and joins rows on a number.

The dictionary's files are written in ranges of the folded name, in small row groups with statistics and Bloom filters on
it. A term that must begin a name, or be all of it, is also asked of the folded name, which the scan takes over: it reads
the row groups whose range can hold the prefix, or whose Bloom filter can hold the name. Other terms read the whole
dictionary, by its character masks.

Defined results: names that differ in case are names of their own; a null name has no id, and its rows aren't kept. Rows
that repeat are kept. Each extension is a generation of its own, as wide as what is new.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import predicates as P
from quarry.functions import query as Q
from quarry.operators.ranking import placed
from quarry.operators.search import fan_out
from quarry.operators.storage import shared_folder

#: Bytes of a row group of the dictionary: what a prefix reads at least.
ROW_GROUP = 1 << 20
NAMES = "name_id long, name string, folded string, mask long, generation int"


def folded(name: Column) -> Column:
    return F.lower(F.trim(name))


def asked_of_folded(pattern: Q.Pattern) -> Column | None:
    """What each set of a single prefix or equality term says of the folded name; the scan can take it over. A term with white
    space at an end isn't asked, as the folded name has none there."""
    tests = []
    for terms in pattern.sets:
        t = terms[0]
        if len(terms) == 1 and not t.inverse and t.kind in (Q.PREFIX, Q.EQUAL) and t.text and t.text == t.text.strip():
            tests.append(F.col("folded").startswith(t.text.lower()) if t.kind == Q.PREFIX else F.col("folded") == t.text.lower())
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


class NameDictionary:
    """names/g<n>: the names of a generation; rows/g<n>: its rows with name_id."""

    def __init__(self, spark: SparkSession, folder: str | None = None, row_group: int = ROW_GROUP):
        self.spark, self.folder, self.row_group = spark, folder or f"{shared_folder(spark)}/names-{uuid.uuid4().hex}", row_group
        self.generations = 0

    def names(self) -> DataFrame:
        places = [f"{self.folder}/names/g{g}" for g in range(self.generations)]
        return self.spark.read.schema(NAMES).parquet(*places) if places else self.spark.createDataFrame([], NAMES)

    def rows(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.folder}/rows/g{g}" for g in range(self.generations)))

    def extend(self, rows: DataFrame) -> None:
        """Adds rows; names that aren't known yet get ids behind those that are."""
        g, known = self.generations, self.names()
        last = known.agg(F.max("name_id")).first()[0] or 0
        fresh = rows.select("name").where("name is not null").distinct().join(known.select("name"), "name", "left_anti")
        made = placed(fresh.withColumn("folded", folded(F.col("name"))).orderBy("folded", "name"), "place")
        made = made.select((F.col("place") + last).alias("name_id"), "name", "folded", P.mask_column(F.col("name")).alias("mask"), F.lit(g).alias("generation"))
        # the places' ranges are those of the sort; each is written in its order
        writer = made.sortWithinPartitions("folded", "name").write.mode("overwrite").option("parquet.block.size", self.row_group).option("parquet.bloom.filter.enabled#folded", "true").option("parquet.page.row.count.limit", 1000)
        writer.parquet(f"{self.folder}/names/g{g}")
        self.generations += 1
        kept = fan_out(self.names().select("name", "name_id"), rows.where("name is not null")).drop("name")
        kept.write.mode("overwrite").parquet(f"{self.folder}/rows/g{g}")

    def matching(self, pattern: Q.Pattern) -> DataFrame:
        """(name_id, name) of the names that match."""
        names = self.names()
        if (asked := asked_of_folded(pattern)) is not None:
            names = names.where(asked)
        return names.where(P.mask_filter(F.col("mask"), pattern)).where(P.pattern_column(F.col("name"), pattern)).select("name_id", "name")

    def search(self, pattern: Q.Pattern) -> DataFrame:
        """The rows of the names that match, joined on ids."""
        return self.rows().join(self.matching(pattern), "name_id")
