"""The bucket store and the live view against batch compaction, in steps, with lost and repeated steps."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.operators import maintenance as M
from quarry.operators.buckets import BucketStore
from quarry.streaming import journal as J
from quarry.streaming import live

KEPT = "id long, parent_id long, name string, size long, source_key string"
CHANGE = "usn long, id long, parent_id long, name string, action string, refresh boolean, size long, ts timestamp"


def base_of(spark, n=200):
    return spark.createDataFrame([(i, i % 7, f"n{i}", i, "P") for i in range(n)], KEPT)


def journal(seed, n=300, ids=230, start=0):
    rng = random.Random(seed)
    at = datetime(2024, 1, 1)
    out = []
    for u in range(start, start + n):
        i = rng.randrange(ids)
        action = rng.choice(["add", "remove", "hide", "toggle", "toggle", "refresh", "skip"])
        own = rng.random() < 0.6
        out.append((u, i, i % 7 if own else rng.randrange(3), f"n{i}" if own else f"m{rng.randrange(3)}", action, action in ("add", "refresh"), rng.randrange(1000), at + timedelta(minutes=u)))
    return out


def rows(df):
    return sorted((r["id"], r["parent_id"], r["name"], -1 if r["size"] is None else r["size"]) for r in df.collect())


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_reads_equal_the_batch_before_and_after_compactions(spark, tmp_path):
    base, changes = base_of(spark), journal(1)
    store = BucketStore(spark, f"{tmp_path}/s")
    store.create(base, 8)
    assert rows(store.read()) == rows(base) and store.n_rows() == 200
    for number, k in enumerate(range(0, 300, 60)):
        store.append(spark.createDataFrame(changes[k : k + 60], CHANGE), number)
        want = rows(M.compact(base, spark.createDataFrame(changes[: k + 60], CHANGE)))
        assert rows(store.read()) == want
        if number % 2:
            assert store.compact() and store.n_pending() == 0
            assert rows(store.read()) == want and store.n_rows() == len(want)
    assert store.n_pending() == 60
    assert store.read().columns == base.columns


def test_only_buckets_that_changed_are_written(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/s")
    store.create(base_of(spark), 8)
    before = files(f"{tmp_path}/s/rows")
    assert len(before) == 8
    one = [(0, 5, 5, "n5", "remove", False, 0, None), (1, 5, 1, "x", "add", True, 9, None)]
    store.append(spark.createDataFrame(one, CHANGE), 0)
    (touched,) = store.compact()
    after = files(f"{tmp_path}/s/rows")
    kept = {p: t for p, t in before.items() if p in after}
    assert len(kept) == 7 and all(after[p] == t for p, t in kept.items()) and len(after) == 8
    assert all(f"_bucket={touched}/" in p for p in set(after) - set(kept))
    assert not files(f"{tmp_path}/s/deltas")


def test_steps_that_are_run_again(spark, tmp_path):
    base, changes = base_of(spark, 30), journal(2, 40, 30)
    df = lambda a, b: spark.createDataFrame(changes[a:b], CHANGE)
    store = BucketStore(spark, f"{tmp_path}/s")
    store.create(base, 4)
    keeper = J.Compactor(base, store, threshold=25)
    keeper.step(df(0, 20), 0)
    keeper.step(df(0, 20), 0)  # lost after its delta was written
    assert store.n_pending() == 20 and store.manifest()["folded"] == -1
    keeper.step(df(20, 30), 1)
    assert store.n_pending() == 0 and store.manifest()["folded"] == 1
    keeper.step(df(20, 30), 1)  # lost after it was compacted
    assert store.n_pending() == 0
    keeper.step(df(0, 0), 2)
    keeper.step(df(30, 40), 3)
    assert store.n_pending() == 10 and rows(store.read()) == rows(M.compact(base, df(0, 40)))
    assert rows(BucketStore(spark, f"{tmp_path}/s").read()) == rows(store.read())  # opened anew
    assert len(list(Path(f"{tmp_path}/s/manifests").glob("*.json"))) == 2


def test_a_compaction_that_is_lost_leaves_the_old_state(spark, tmp_path, monkeypatch):
    base, changes = base_of(spark, 30), spark.createDataFrame(journal(3, 40, 30), CHANGE)
    store = BucketStore(spark, f"{tmp_path}/s")
    store.create(base, 4)
    store.append(changes, 0)
    want = rows(store.read())

    def lost(state):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        m.setattr(store, "_publish", lost)
        store.compact()
    assert rows(store.read()) == want and store.n_pending() == 40
    store.compact()
    assert rows(store.read()) == want and store.n_pending() == 0


def test_empty_base_and_emptied_buckets(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/s")
    store.create(base_of(spark).limit(0), 4)
    assert rows(store.read()) == []
    store.append(spark.createDataFrame([(0, 1, 1, "a", "add", True, 3, None)], CHANGE), 0)
    assert rows(store.read()) == [(1, 1, "a", 3)]
    store.compact()
    store.append(spark.createDataFrame([(1, 1, 1, "a", "remove", False, 0, None)], CHANGE), 1)
    store.compact()
    assert rows(store.read()) == [] and store.n_rows() == 0


def test_live_view_over_two_starts(spark, tmp_path):
    """State and timers come back from the checkpoint: the view is that of one run, and nothing is told twice."""
    base, changes = base_of(spark, 40), journal(4, 200, 45)
    more = [(500, None, 1, "x", "add", True, 1, datetime(2024, 1, 1)), (501, 44, None, None, "add", True, 77, datetime(2024, 1, 2)), (900, 999, 1, "late", "add", True, 1, datetime(2024, 2, 1))]
    for part in (changes[:110], changes[110:], more):
        spark.createDataFrame(part, CHANGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/journal")
        stream = J.tail(spark, f"{tmp_path}/journal", spark.read.parquet(f"{tmp_path}/journal").schema)
        live.keep_states(live.live_states(stream, 60_000 * 90), f"{tmp_path}/states", f"{tmp_path}/check").awaitTermination()
    got = rows(live.view(base, spark, f"{tmp_path}/states"))
    assert got == rows(M.compact(base, spark.createDataFrame(changes + [more[1], more[2]], CHANGE).where("name is not null").unionByName(spark.createDataFrame([(501, 44, -9, "-", "refresh", True, 77, None)], CHANGE))))
    quiet = [r for r in spark.read.parquet(f"{tmp_path}/states").where("kind = 'quiet'").collect()]
    counts = {}
    for r in quiet:
        counts[r["id"]] = counts.get(r["id"], 0) + r["n"]
    want = {i: sum(c[1] == i for c in changes) for i in {c[1] for c in changes}}
    want[44] = want.get(44, 0) + 1
    assert counts == want  # each record is in one quiet period, all but those of the newest id closed
    assert len(quiet) >= len(want)


def test_journal_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """Files hold RECORDS offsets at most and come in their order, so a trigger's memory doesn't follow the journal; the view
    over many triggers is the compaction, though times run against the offsets."""
    from quarry.plans import maintenance as P

    monkeypatch.setattr(P, "RECORDS", 30)
    changes = spark.createDataFrame(journal(4, 100, 12), CHANGE).withColumn("ts", F.expr("timestamp'2024-03-01' - make_interval(0, 0, 0, 0, cast(usn as int) * 5)"))
    seen, parts = set(), 0
    for k, n in P._journal_in_parts(changes, f"{tmp_path}/j", 2):
        got = {r["usn"] for r in spark.read.parquet(f"{tmp_path}/j").select("usn").collect()}
        assert len(got - seen) <= 30 and (not seen or max(seen) < min(got - seen))
        seen, parts = got, k + 1
    assert parts == n > 2 and len(seen) == changes.count()
    monkeypatch.setattr(P, "_changes", lambda spark, sf_dir, *more: changes)
    monkeypatch.setattr(P, "_links", lambda spark, sf_dir: base_of(spark))
    assert sorted(map(tuple, P.stream_live_view(spark, "").collect())) == sorted(map(tuple, M.compact(base_of(spark), changes).select("id", "parent_id", "name", "size").collect()))


def test_live_view_keeps_neighbouring_ids_together(spark, tmp_path):
    """A store's entry and a call go for a bucket of ids, not for each id or link; ids of a bucket are quiet each at its own
    time, the state lies in as many partitions as asked for, and whole numbers beyond a double's stay exact beside nulls."""
    at, big = datetime(2024, 1, 1), (1 << 60) + 1
    first = [(u, u % 500, big, f"n{u % 500}", "add", True, big, at + timedelta(minutes=u % 500)) for u in range(1000)] + [(1000, 3, None, None, "refresh", True, None, at)]
    then = [(2000, 7, big, "n7", "toggle", False, big + 1, at + timedelta(days=1)), (2001, 3, big, "m3", "add", False, None, at)]
    stores = []
    for part in (first, then):
        spark.createDataFrame(part, CHANGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/journal")
        stream = J.tail(spark, f"{tmp_path}/journal", spark.read.parquet(f"{tmp_path}/journal").schema)
        query = live.keep_states(live.live_states(stream, 60_000, "3 days"), f"{tmp_path}/states", f"{tmp_path}/check", 2)
        query.awaitTermination()
        stores += [p["stateOperators"][0] for p in query.recentProgress]
    assert max(s["numRowsTotal"] for s in stores) <= 2 * 4 and {s["numStateStoreInstances"] for s in stores} == {2}
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    base = base_of(spark, 10)
    whole = [c for c in first + then if c[3] is not None] + [(1000, 3, -9, "-", "refresh", True, None, at)]
    assert rows(live.view(base, spark, f"{tmp_path}/states")) == rows(M.compact(base, spark.createDataFrame(whole, CHANGE)))
    timed = live.live_states(J.tail(spark, f"{tmp_path}/journal", spark.read.parquet(f"{tmp_path}/journal").schema), 60_000, "10 minutes")
    live.keep_states(timed, f"{tmp_path}/quiet", f"{tmp_path}/check2").awaitTermination()
    quiet = {r["id"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/quiet").where("kind = 'quiet'").collect()}
    assert quiet == {i: 2 + 2 * (i == 3) for i in range(500) if i != 7}  # all but that of the newest record
