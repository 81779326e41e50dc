"""Queries answer for all rows and whole texts, against models of their own."""

import random

from pyspark.sql import functions as F

from quarry.operators import ranking as R
from quarry.functions import scoring as S
from quarry.plans import registry
from quarry.sources import catalog


def _subsequence(text, term):
    at = iter(text.lower())
    return all(c in at for c in term)


def test_fuzzy_long_sees_whole_texts(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in catalog.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    got = {r["id"]: (r["begin"], r["end"], r["score"]) for r in registry.queries()["match_fuzzy_long"](spark, sf_dir).collect()}
    assert set(got) == {i for i, t in texts.items() if t and _subsequence(t, "entrale")}
    assert any(end > len(texts[i].split("\n")[0]) for i, (_, end, _) in got.items())
    assert all(got[i] == S.fuzzy(texts[i], "entrale")[:3] for i in got)


def test_fuzzy_long_reaches_the_greedy_scan(spark, tmp_path):
    text = "e" + "\n" * 300_000 + "ntrale e|ntrale"
    spark.createDataFrame([(1, text), (2, "e\nn t r a l"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = registry.queries()["match_fuzzy_long"](spark, str(tmp_path)).collect()
    start = text.rindex("e|")
    assert (row["id"], row["begin"], row["end"], row["score"]) == (1, start, len(text), S.span_score(text, "entrale", start, len(text)))


def _parents(spark, sf_dir):
    """id -> (parent, name) of the whole tree."""
    return {r["id"]: (r["parent_id"], r["name"]) for r in catalog.tree(spark, sf_dir).collect()}


def _chain(tree, i):
    out = []
    while i != 1:
        i = tree[i][0]
        out.append(i)
    return out


def test_self_listing_is_all_below_the_directory(spark, sf_dir):
    tree = _parents(spark, sf_dir)
    asia = next(i for i, (_, name) in tree.items() if name == "ASIA")
    rows = registry.queries()["filter_self"](spark, sf_dir).collect()
    assert {r["id"] for r in rows} == {i for i in tree if asia in _chain(tree, i)} and len({r["id"] for r in rows}) == len(rows)
    assert {r["path"].count("/") for r in rows} == {2, 3, 4}


def test_rename_reaches_all_nodes(spark, sf_dir):
    tree = _parents(spark, sf_dir)
    new = {i: f"renamed-{i - 10000}" for i in tree if 10000 <= i < 1000000 and i % 4 == 0}
    got = [(r["id"], r["path"]) for r in registry.queries()["cdc_rename"](spark, sf_dir).collect()]
    shown = lambda i: new.get(i, tree[i][1])
    assert sorted(got) == sorted((i, "/".join(["T:", *map(shown, _chain(tree, i)[-2::-1]), shown(i)])) for i in tree if i != 1)


def test_closure_has_directories(spark, sf_dir):
    tree = _parents(spark, sf_dir)
    got = [(r["id"], r["ancestor"]) for r in registry.queries()["join_ancestors"](spark, sf_dir).collect()]
    assert sorted(got) == sorted((i, a) for i in tree for a in _chain(tree, i))


def _placed_ids(spark, sf_dir, name):
    rows = [(r["place"], r["id"]) for r in registry.queries()[name](spark, sf_dir).collect()]
    assert rows == sorted(rows)
    assert [p for p, _ in rows] == list(range(1, len(rows) + 1))
    return [i for _, i in rows]


def test_orders_place_every_row(spark, sf_dir):
    parts = catalog.parts(spark, sf_dir).collect()
    latest = {r[0]: r[1] for r in catalog.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id")).collect() if r[0] is not None}
    cross = lambda r: (-latest[r["id"]] if r["id"] in latest else 2**63 - 1, r["id"] % 11, len(r["path"]), r["source_key"].lower(), r["path"].lower(), r["id"])
    ids = lambda rows, key: [r["id"] for r in sorted(rows, key=key)]
    assert _placed_ids(spark, sf_dir, "sort_columns") == ids(parts, lambda r: (r["name"].lower(), r["id"]))
    assert _placed_ids(spark, sf_dir, "token_sort") == ids(parts, lambda r: (-r["size"], r["id"]))
    assert _placed_ids(spark, sf_dir, "token_chain") == ids([r for r in parts if r["ext"] in ("economy", "promo")], lambda r: (r["size"], r["id"]))
    assert _placed_ids(spark, sf_dir, "order_results") == ids(parts, cross)


def test_places_go_on_across_ranges(spark):
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("id"))
        out = R.numbered(ids, F.col("id") % 3, F.desc("id"))
        assert out.rdd.getNumPartitions() > 1
        assert [(r["place"], r["id"]) for r in out.collect()] == list(enumerate(sorted(range(5000), key=lambda i: (i % 3, -i)), 1))
        assert R.numbered(ids.limit(0), "id").collect() == []
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
