"""Registered directories, display paths, keyword items, journal offsets."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import joins as J
from quarry.operators import maintenance as M
from quarry.operators import ranking as R
from quarry.operators.providers import DirectoryRegistry


def test_registered_directories(spark):
    rows = spark.createDataFrame([("A/b/x.txt", 1), ("a/b/x.txt", 1), ("a/b/c/y.txt", 2), ("a/z.md", 3), (None, 4), ("q", 5), ("a\\b\\w.TXT", 6), ("A/b/x.txt", 1)], "path string, owner int").withColumnRenamed("owner", "n")
    r = DirectoryRegistry()
    r.register("one", "a\\b\\", False, "*.txt")
    r.register("one", "A")
    r.register("two", "a/b", True, "*.txt")
    r.register("gone", "")
    r.unregister("gone")
    got = sorted((x["owner"], x["path"]) for x in r.listed(rows).collect())
    assert got == sorted([("one", p) for p in ("A/b/x.txt", "A/b/x.txt", "a/b/x.txt", "a/b/c/y.txt", "a/z.md", "a\\b\\w.TXT")] + [("two", p) for p in ("A/b/x.txt", "A/b/x.txt", "a/b/x.txt", "a/b/c/y.txt", "a\\b\\w.TXT")])
    assert {x["n"] for x in r.search(rows, "two", "Y").collect()} == {2}
    assert {x["owner"]: x["changes"] for x in r.changed(rows).collect()} == {"one": 6, "two": 5}
    assert r.listed(rows.limit(0)).count() == 0 and DirectoryRegistry().listed(rows).count() == 0


def test_paths_as_shown(spark):
    df = spark.createDataFrame([("P:/a/b/c",), ("p:/A/x",), ("P:/ab/c",), ("Q:/a",), (None,)], "path string")
    shown = df.select(R.shown_path(F.col("path"), {"P:/": "//s", "p:/a": "/mnt/a/"}).alias("s"), R.relative_parent(F.col("path"), "P:/a/").alias("r"), "path").collect()
    assert [x["s"] for x in shown] == ["/mnt/a/b/c", "/mnt/a/x", "//s/ab/c", "Q:/a", None]
    assert [x["r"] for x in shown] == ["b", "", "P:/ab", "Q:", None]


def test_catch_up_from_a_header(spark):
    journal = spark.createDataFrame([(u, u * 2) for u in range(10, 20)], "usn long, id long")
    got = M.journal_since(journal, {"journal_id": 7, "next_usn": 15}, 7).collect()
    assert sorted(r["usn"] for r in got) == [15, 16, 17, 18, 19] and {r["next_usn"] for r in got} == {20}
    assert M.journal_since(journal, {"journal_id": 7, "next_usn": 20}, 7).count() == 0
    assert M.journal_since(journal.limit(0), {"journal_id": 7, "next_usn": 3}, 7).count() == 0
    for header in ({"journal_id": 6, "next_usn": 15}, {"journal_id": 7, "next_usn": 9}, {"journal_id": 7, "next_usn": 21}):
        with pytest.raises(LookupError):
            M.journal_since(journal, header, 7)


def test_bookmarks_and_keyword_items(spark):
    marks = spark.createDataFrame([(1, "own"), (1, None), (1, ""), (2, "x"), (None, "y")], "place long, title string")
    places = spark.createDataFrame([(1, "place"), (3, "other")], "place long, title string")
    assert sorted(r["title"] for r in J.bookmarks(marks, places).collect()) == ["own", "place", "place"]
    rows = spark.createDataFrame([(1, "bolt", "k"), (2, "nut", "k"), (3, "bolt", "z")], "id long, name string, weight string").drop("weight")
    own = F.col("id") < 3
    shown = lambda t: {(r["id"], r["weight"]) for r in R.keyword_items(rows, t, "set", own).collect()}
    assert shown("set") == {(1, 1.0), (2, 1.0)} and shown("set 'bo") == {(1, 0.5)} and shown("other") == set()
