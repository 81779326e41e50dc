"""The journal as a data source: ranges, offsets, resumption."""

import pytest

from quarry.sources import journal_source as S
from quarry.streaming import journal as J


@pytest.fixture
def events(spark, tmp_path):
    rows = [(u, u % 7 if u % 5 else None, "click" if u % 2 else "view", "x") for u in range(100, 400)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, more string")
    for part in ("event_id < 250", "event_id >= 250"):
        df.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    S.register(spark)
    return f"{tmp_path}/events", [r[:3] for r in rows]


def test_batch_reads_in_ranges(spark, events):
    path, rows = events
    df = spark.read.format("quarry_journal").option("path", path).option("partitions", 5).load()
    assert df.columns == ["usn", "id", "event_type"] and df.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, df.collect())) == rows
    assert S.bounds(path) == (100, 400)
    assert [(s.first, s.behind) for s in S.stretches(3, 10, 3)] == [(3, 6), (6, 9), (9, 10)] and S.stretches(5, 5, 3) == []
    part = spark.read.format("quarry_journal").option("path", path).option("until", 150).load()
    assert part.count() == 50


def test_stream_goes_on_behind_its_offset(spark, events, tmp_path):
    path, rows = events

    def run(**options):
        stream = spark.readStream.format("quarry_journal").options(path=path, journal_id=7, **options).load()
        J.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/check")
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))

    assert run(until=180) == rows[:80]
    assert run(until=180) == rows[:80]  # nothing new, nothing twice
    assert run() == rows
    more = spark.createDataFrame([(400, 1, "error", "x")], "event_id long, user_id long, event_type string, more string")
    more.coalesce(1).write.mode("append").parquet(path)
    assert run() == [*rows, (400, 1, "error")]
    more.selectExpr("event_id + 1 event_id", "user_id", "event_type", "more").coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(Exception, match="not of 8"):
        stream = spark.readStream.format("quarry_journal").options(path=path, journal_id=8).load()
        J.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/check")
