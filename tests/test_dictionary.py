"""Stable name ids, and what a scan of the dictionary leaves unread."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import query as Q
from quarry.operators import dictionary as D
from quarry.operators import search as N


def rows_of(spark, n, start=0, seed=1):
    rng = random.Random(seed)
    words = ["Bolt", "blue", "red", "Ring", "nut", "plate", "é", " x "]
    return spark.createDataFrame([(i, f"{rng.choice(words)} {rng.choice(words)} {rng.randrange(40)}" if i % 29 else None, i * 2) for i in range(start, start + n)], "id long, name string, size long")


def test_ids_stay_over_extensions(spark, tmp_path):
    d = D.NameDictionary(spark, str(tmp_path))
    d.extend(rows_of(spark, 300))
    first = {r["name"]: r["name_id"] for r in d.names().collect()}
    assert sorted(first.values()) == list(range(1, len(first) + 1))
    for k in (1, 2):
        d.extend(rows_of(spark, 200, 300 * k, seed=k + 5))
        now = {r["name"]: r["name_id"] for r in d.names().collect()}
        assert {n: i for n, i in now.items() if n in first} == first
        assert sorted(now.values()) == list(range(1, len(now) + 1)) and len(now) > len(first)
        first = now
    d.extend(rows_of(spark, 0))
    every = rows_of(spark, 300).union(rows_of(spark, 200, 300, 6)).union(rows_of(spark, 200, 600, 7)).where("name is not null")
    got = d.rows().join(d.names().select("name_id", "name"), "name_id").select("id", "name", "size")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))


@pytest.mark.parametrize("text", ["'bolt", "^blue", "^Blue", "ring$", "^red\\ nut\\ 3$", "^x", "!nut", "^blue !red", "^red | ^ring", "bl3"])
def test_search_by_ids_is_search_by_names(spark, tmp_path, text):
    rows = rows_of(spark, 400).where("name is not null")
    d = D.NameDictionary(spark, str(tmp_path))
    d.extend(rows.where("id < 250"))
    d.extend(rows.where("id >= 250"))
    pattern = Q.parse_pattern(text)
    want = N.fan_out(N.matching_names(rows, pattern), rows).select("id", "name")
    assert sorted(map(tuple, d.search(pattern).select("id", "name").collect())) == sorted(map(tuple, want.collect()))


def row_groups(df):
    """Rows that the scans of a plan have put out, all of the row groups they have read."""
    plan = df._jdf.queryExecution().executedPlan()
    stack, found = [plan], 0
    while stack:
        p = stack.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            p = p.executedPlan()
        if p.nodeName().startswith("Scan parquet"):
            found += p.metrics().apply("numOutputRows").value()
        stack += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_scans_read_few_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select("id", F.concat(F.substring(F.md5(F.col("id").cast("string")), 1, 12), F.lit(" name")).alias("name"))
    d = D.NameDictionary(spark, str(tmp_path), row_group=1 << 18)
    d.extend(rows)
    kept = spark.conf.get("spark.sql.parquet.enableVectorizedReader")
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "true")
    try:
        read = {}
        for text in ("'zzz", "^abcd", "^c4ca4238a0b9\\ name$"):
            found = d.matching(Q.parse_pattern(text))
            plan = found._jdf.queryExecution().executedPlan().toString()
            n = found.collect()
            read[text] = row_groups(found)
            if text.startswith("^"):
                assert "PushedFilters: [" in plan and ("StringStartsWith(folded" in plan or "EqualTo(folded" in plan)
        assert len(n) == 1
        assert read["'zzz"] == 200_000
        assert read["^abcd"] < 60_000 and read["^c4ca4238a0b9\\ name$"] < 60_000
    finally:
        spark.conf.set("spark.sql.parquet.enableVectorizedReader", kept)
