"""Queries of the stored name dictionary and of the journal as a data source."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import query as Q
from quarry.operators.dictionary import NameDictionary
from quarry.operators.storage import Snapshots
from quarry.plans.registry import query
from quarry.sources import catalog


def _dictionary(spark, sf_dir) -> NameDictionary:
    """Built of two thirds of the parts and extended by the rest in two steps."""
    rows = catalog.parts(spark, sf_dir).select("id", "name", "size")
    found = NameDictionary(spark)
    for step in ("id % 9 < 6", "id % 9 in (6, 7)", "id % 9 = 8"):
        found.extend(rows.where(step))
    return found


@query("""WITH g AS (SELECT name, CAST(min(CASE WHEN id % 9 < 6 THEN 0 WHEN id % 9 < 8 THEN 1 ELSE 2 END) AS INTEGER) AS generation FROM parts GROUP BY name)
SELECT row_number() OVER (ORDER BY generation, lower(trim(name)), name) AS name_id, name, lower(trim(name)) AS folded, generation FROM g""")
def dictionary_ids(spark, sf_dir):
    """Ids by the order of the folded names, those of later generations behind all before."""
    return _dictionary(spark, sf_dir).names().select("name_id", "name", "folded", "generation")


@query("SELECT id, name, size FROM parts WHERE starts_with(lower(name), 'blue') AND contains(lower(name), 'bolt')")
def search_by_ids(spark, sf_dir):
    """Names by a prefix that the scan takes over, rows by their ids."""
    return _dictionary(spark, sf_dir).search(Q.parse_pattern("^blue 'bolt")).select("id", "name", "size")


@query("SELECT event_id AS usn, user_id AS id, event_type FROM events")
def stream_journal_source(spark, sf_dir):
    """The journal through its data source, in two starts of a stream that goes on by offset."""
    from quarry.sources import journal_source
    from quarry.streaming import journal as J

    journal_source.register(spark)
    path, folder = f"{sf_dir}/events.parquet", Snapshots(spark).folder
    half = (catalog.journal(spark, sf_dir).agg(F.max("usn")).first()[0] or 0) // 2
    for more in ({"until": half}, {}):
        stream = spark.readStream.format("quarry_journal").options(path=path, journal_id=7, **more).load()
        J.run_to_table(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(journal_source.SCHEMA).parquet(f"{folder}/out")
