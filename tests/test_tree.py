"""Directory numbers: scopes and cascades as ranges, against walks of random trees."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import tree as W


def random_tree(seed, n=300):
    """(id, parent): deep and wide parts, two tops, orphans, a ring with nodes below it."""
    rng = random.Random(seed)
    rows = [(1, 1), (2, 2)]
    for i in range(3, n):
        near = rows[-1][0] if rng.random() < 0.3 else rng.choice(rows)[0]
        rows.append((i, 10_000 if rng.random() < 0.02 else near))
    rows += [(900, 901), (901, 902), (902, 900), (903, 901), (904, 903)]
    rng.shuffle(rows)
    return rows


def below(rows, tops):
    gone, more = set(), set(tops)
    while more:
        gone |= more
        more = {i for i, p in rows if p in gone and i != p} - gone
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_scopes_are_ranges(spark, seed):
    rows = random_tree(seed)
    nodes = spark.createDataFrame([(i, p, f"n{i}", "first") for i, p in rows], "id long, parent_id long, name string, kind string")
    labels = W.cut_lineage(W.subtree_labels(nodes))
    got = {r["id"]: (r["first"], r["last"]) for r in labels.collect()}
    parents = {p for i, p in rows}
    rings = {900, 901, 902, 903, 904}
    assert set(got) == {i for i, _ in rows if i in parents} - rings
    assert sorted(f for f, _ in got.values()) == list(range(1, len(got) + 1))
    for d, (first, last) in got.items():
        assert {e for e, (f, _) in got.items() if first <= f <= last} == below(rows, [d]) & set(got)
    placed = W.cut_lineage(W.labelled(nodes, labels))
    assert placed.count() == len(rows) and placed.columns == [*nodes.columns, "within"]
    for d in random.Random(seed).sample(sorted(got), 8):
        assert {r["id"] for r in W.in_scope(placed, labels, d).collect()} == below(rows, [d]) - {d}
    assert W.in_scope(placed, labels, 123_456).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_cascade_by_ranges(spark, seed):
    rows = random_tree(seed)
    nodes = spark.createDataFrame([(i, p) for i, p in rows], "id long, parent_id long")
    rng = random.Random(seed)
    for removed in ([], [1], [900], [904, 5], rng.sample([i for i, _ in rows], 20) + [77_777]):
        got = W.cascade(nodes, spark.createDataFrame([(i,) for i in removed * 2], "id long")).collect()
        assert sorted(r["id"] for r in got) == sorted(below(rows, removed))


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_covered_across_stretches(spark, stretch):
    rows = random_tree(8)
    nodes = spark.createDataFrame(rows, "id long, parent_id long")
    labels = W.cut_lineage(W.subtree_labels(nodes))
    dirs = {r["id"] for r in labels.collect()}
    removed = random.Random(8).sample(sorted(dirs), 6)
    got = W.covered(labels, spark.createDataFrame([(i,) for i in removed], "id long"), stretch).collect()
    assert {r["id"] for r in got} == below(rows, removed) & dirs


def test_no_directories(spark):
    nodes = spark.createDataFrame([(1, 10), (2, 10), (3, None)], "id long, parent_id long")
    assert W.subtree_labels(nodes).count() == 0
    assert sorted(r["id"] for r in W.cascade(nodes, nodes.where("id = 2").select("id")).collect()) == [2]
    assert W.cascade(nodes.limit(0), nodes.limit(0).select("id")).count() == 0
    paths = W.with_paths(nodes.withColumn("name", F.lit("x")))
    assert {r["id"]: r["path"] for r in paths.collect()} == {1: "T:/x", 2: "T:/x", 3: "T:/x"}
