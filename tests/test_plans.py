"""All registered queries against DuckDB, plan shapes, UDF row counts, random trees against a Python model."""

import hashlib
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions import predicates as P
from quarry.functions import query as Q
from quarry.functions import scoring as S
from quarry.operators import maintenance as M
from quarry.operators import paths as H
from quarry.operators import search as N
from quarry.operators import tree as W
from quarry.operators.storage import Snapshots
from quarry.plans import registry
from quarry.sources import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf_dir, duck):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_udf_sees_distinct_names_only(spark, sf_dir):
    seen = spark.sparkContext.accumulator(0)
    pattern = Q.parse_pattern("'ring")

    def count(names):
        seen.add(len(names))
        return names.map(lambda x: len(S.marks(x, pattern)))

    score = F.pandas_udf(count, "int").asNondeterministic()
    rows = catalog.parts(spark, sf_dir)
    names = rows.select("name").distinct().withColumn("s", score("name")).where("s > 3")
    rows.join(names, "name").collect()
    assert seen.value == rows.select("name").distinct().count()


def test_prefilter_runs_below_python(spark, sf_dir):
    plan = N.scored_names(catalog.parts(spark, sf_dir), Q.parse_pattern("bolt"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.index("ArrowEvalPython") < plan.index("shiftleft")


def test_random_trees_against_model(spark):
    rng = random.Random(9)
    words = ["temp", "report", "alpha", "beta", "re", "port"]
    found = 0
    for _ in range(3):
        dirs = {1: ("", None)}
        for i in range(2, 10):
            dirs[i] = (rng.choice(words) + str(rng.randint(0, 2)), rng.choice(list(dirs)))
        rows = []
        for i in range(100, 140):
            parent = rng.choice(list(dirs))
            up, at = [], parent
            while at != 1:
                up.insert(0, dirs[at][0])
                at = dirs[at][1]
            name = rng.choice(words) + "_" + rng.choice(words) + ".txt"
            rows.append((i, name, "/".join(up), [*up, name]))
        df = spark.createDataFrame(rows, "id long, name string, parent_path string, names array<string>")
        for text in ("report temp", "re !alpha", "'al 'be"):
            sets = Q.parse_pattern(text).sets

            def met(s, segments):
                return any((S.term_match(x, s[0]) is None) == s[0].inverse for x in segments)

            want = {i for i, name, _, names in rows if all(met(s, names) for s in sets) and any(met(s, [name]) for s in sets) and not all(met(s, [name]) for s in sets)}
            got = {r["id"] for r in H.term_fallback(df, text, 10_000).collect()}
            assert got == want
            found += len(got)
    assert found > 20


def test_random_names_predicates_agree_with_scoring(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("ab c1_/AB") for _ in range(rng.randint(1, 8))) for _ in range(200)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for text in ("ab", "'ab", "'a'", "^a", "b$", "!c", "a | !b", "!b | a", "A", "^'a c$"):
        p = Q.parse_pattern(text)
        got = [r[0] for r in df.select(P.pattern_column(F.col("name"), p)).collect()]
        assert got == [S.pattern_match(n, p) is not None for n in names], text


KEPT = "id long, parent_id long, name string, size long"
CHANGE = "usn long, id long, parent_id long, name string, action string, refresh boolean, size long"


def replay(base, changes, directories=False):
    """Record by record: links as a journal reader keeps them; what makes a link gives it its size, a refresh all of an id."""
    now = {r[:3]: r[3] for r in base}
    for usn, id_, parent, name, action, refresh, size in sorted(changes):
        key = (id_, parent, name)
        if action == "add" or (action == "toggle" and key not in now):
            now[key] = size
        elif action in ("remove", "hide", "toggle"):
            now.pop(key, None)
            if action == "remove" and directories and not any(k[0] == id_ for k in now):
                gone = {id_}
                while True:
                    below = {k for k in now if k[1] in gone}
                    if not below:
                        break
                    gone = {k[0] for k in below}
                    for k in below:
                        del now[k]
        if refresh:
            now.update((k, size) for k in now if k[0] == id_)
    return {(*k, v) for k, v in now.items()}


def test_compaction_replay(spark):
    """Refresh and skip records remove nothing; toggles count from the last add, remove or hide on."""
    rng = random.Random(6)
    for trial in range(3):
        base = [(i, i % 3, f"n{i}", i) for i in range(20)]
        changes = []
        for u in range(150):
            i = rng.randint(0, 25)
            action = rng.choice(["add", "remove", "refresh", "skip", "hide", "toggle"])
            changes.append((u, i, i % 3, rng.choice([f"n{i}", f"m{i}"]), action, action in ("add", "refresh") or (action == "toggle" and u % 2 == 0), 1000 + u))
        got = M.compact(spark.createDataFrame(base, KEPT), spark.createDataFrame(changes, CHANGE))
        assert {tuple(r) for r in got.collect()} == replay(base, changes)
    only = [(1, 1, 1, "n1", "refresh", True, 77), (2, 2, 2, "n2", "skip", False, 88)]
    got = M.compact(spark.createDataFrame(base[:3], KEPT), spark.createDataFrame(only, CHANGE))
    assert {tuple(r) for r in got.collect()} == {(0, 0, "n0", 0), (1, 1, "n1", 77), (2, 2, "n2", 2)}
    empty = spark.createDataFrame([], CHANGE)
    assert {tuple(r) for r in M.compact(spark.createDataFrame(base, KEPT), empty).collect()} == set(base)


def test_compaction_takes_what_is_below_a_removed_directory(spark):
    base = [(2, 1, "a", 0), (3, 2, "b", 0), (4, 3, "f", 5), (5, 2, "g", 6), (6, 1, "c", 0), (7, 6, "h", 7), (8, 1, "d", 0), (9, 8, "i", 8)]
    changes = [
        (1, 4, 3, "f", "hide", False, 0), (2, 4, 6, "f", "add", False, 5),  # moved out: stays
        (3, 7, 6, "h", "hide", False, 0), (4, 7, 3, "h", "add", False, 7),  # moved in: goes
        (5, 2, 1, "a", "remove", False, 0), (6, 10, 3, "late", "add", False, 1),  # comes after, below what is gone
        (7, 8, 1, "d", "hide", False, 0), (8, 8, 1, "renamed", "add", False, 0),  # renamed: what is below follows the id
    ]
    got = M.compact(spark.createDataFrame(base, KEPT), spark.createDataFrame(changes, CHANGE), directories=True)
    assert {tuple(r)[:3] for r in got.collect()} == {(6, 1, "c"), (4, 6, "f"), (8, 1, "renamed"), (9, 8, "i")}


def chain_and_forest(seed):
    rng = random.Random(seed)
    rows = [(1, 1, "")] + [(i, i - 1, f"c{i}") for i in range(2, 73)]  # 71 levels
    rows += [(i, rng.choice([1, *range(100, i)]) if i > 100 else 1, f"t{i}") for i in range(100, 180)]
    rows += [(300, 999, "orphan"), (301, 300, "below"), (400, 401, "r"), (401, 402, "r"), (402, 400, "r"), (403, 402, "tail"), (404, 403, "tail")]
    return rows


def test_trees_of_any_depth(spark):
    rows = chain_and_forest(3)
    up = {i: (p, n) for i, p, n in rows}
    got = {r["id"]: r for r in W.with_paths(spark.createDataFrame(rows, "id long, parent_id long, name string").repartition(3)).collect()}
    assert set(got) == set(up) - {1}
    for i in got:
        above, names, at = [], [], i
        while at in up and at != 1 and at not in above:
            names.insert(0, up[at][1])
            above.insert(0, at)
            at = up[at][0]
        if i >= 400:
            assert got[i]["path"] is None and set(got[i]["ancestors"]) >= {400, 401, 402} - {i}
        else:
            assert got[i]["path"] == "/".join(["T:", *names]) and got[i]["depth"] == len(names)
            assert got[i]["ancestors"] == ([1] if i < 300 else []) + above[:-1]


@pytest.mark.parametrize("removed", [[2], [50], [100], [400], [300, 71], [1], [12345], []])
def test_cascade_of_any_depth(spark, removed):
    rows = chain_and_forest(4)
    gone = set(removed)
    while True:
        more = {i for i, p, _ in rows if p in gone} - gone
        if not more:
            break
        gone |= more
    nodes = spark.createDataFrame(rows, "id long, parent_id long, name string")
    got = W.cascade(nodes, spark.createDataFrame([(i,) for i in removed], "id long"))
    assert sorted(r["id"] for r in got.collect()) == sorted(gone)


def test_debounced_stream_agrees_with_the_batch(spark, tmp_path):
    """What the watermark has closed is what the batch finds, and the rest comes once later records close it."""
    from quarry.streaming import journal as J

    rng = random.Random(2)
    kind = "usn long, id long, ts timestamp"
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    first = [(u, rng.randint(0, 5), at(u * 7)) for u in range(200)]
    for part, rows in enumerate((first, [(1000, 99, at(100_000))])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        J.run_to_table(J.debounced(J.tail(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema), "30 minutes", "10 minutes").select("id", "usn", "n"), f"{tmp_path}/out", f"{tmp_path}/check")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((r["id"], r["usn"], r["n"]) for r in M.sessions(spark.createDataFrame(first, kind), "id", "30 minutes").collect())
    assert got == want and len(got) > 20


def test_offsets_and_rebuild(spark):
    base = spark.createDataFrame([(1, 1, "a", 1)], KEPT)
    rescan = spark.createDataFrame([(8, 1, "z", 8)], KEPT)
    changes = spark.createDataFrame([(5, 1, 1, "a", "remove", False, 0), (9, 2, 1, "b", "add", True, 2)], CHANGE)
    run = lambda header, journal: sorted(r["id"] for r in M.catch_up(base, changes, header, journal, rescan).collect())
    assert run((7, 6), (7, 5, 10)) == [1, 2] and run((7, 5), (7, 5, 10)) == [2]
    assert run((7, 4), (7, 5, 10)) == run((7, 11), (7, 5, 10)) == run((6, 6), (7, 5, 10)) == [8]


def test_bookmark_trees():
    from quarry.sources.bookmarks import links_of

    leaf = '{"type":"url","name":"x","url":"https://x"}'
    deep = '{"type":"folder","name":"f","children":[' * 400 + leaf + "]}" * 400
    assert next(links_of(deep))[1] == 400
    text = '{"roots":{"bar":{"type":"folder","name":"Bar","children":[%s,{"type":"folder","name":"In","children":[%s,{"type":"url","name":"j","url":"javascript:1"}]},{"type":"url","url":"http://n"}]}}}' % (leaf, leaf)
    assert list(links_of(text)) == [("Bar", 1, "x", "https://x"), ("Bar/In", 2, "x", "https://x"), ("Bar", 1, "http://n", "http://n")]
    assert list(links_of(None)) == list(links_of("{")) == list(links_of("3")) == []


def test_ignore_files_down_a_tree(spark, tmp_path):
    from quarry.operators.exclusions import ignored_by
    from quarry.sources.ignorefiles import read_rules

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / ".gitignore").write_text("*.log\nbuild/\n")
    (tmp_path / "a" / ".ignore").write_text("!keep.log\n/b/*.txt\n")
    (tmp_path / "a" / "b" / ".gitignore").write_text("!x.txt\n")
    (tmp_path / "a" / "other.txt").write_text("*\n")
    paths = {"x.log": True, "a/x.log": True, "a/keep.log": False, "keep.log": True, "a/b/y.txt": True, "a/b/x.txt": False, "a/y.txt": False, "build": True}
    rows = spark.createDataFrame([(p, p == "build") for p in paths], "path string, is_dir boolean")
    got = {r["path"]: r["ignored"] for r in ignored_by(rows, read_rules(spark, str(tmp_path)), is_dir="is_dir").collect()}
    assert got == paths


def _names(spark, sf_dir):
    return [r[0] for r in catalog.parts(spark, sf_dir).select("name").distinct().collect()]


def test_search_name_against_model(spark, sf_dir):
    """Every part is scored, ranked, cut, weighted and ranked again in Python."""
    pattern = Q.parse_pattern("smrg !plate")
    rows = [(r["id"], r["name"]) for r in catalog.parts(spark, sf_dir).collect()]
    point = lambda n, b: 0 if b == 0 else (256 if not n[b - 1].isalnum() or n[b - 1].islower() and n[b].isdigit() else 4096) + b
    keyed = []
    for i, n in rows:
        m = S.pattern_match(n, pattern)
        if m:
            keyed.append(((-m[2], len(n.strip()), m[1] - m[0], point(n, m[0]), i), n, m[2]))
    first = sorted(keyed)[: 20 * N.HEADROOM]
    final = sorted(((-int(score * w) if (w := S.weight(S.marks(n, pattern))) < 1 else -score, *key[1:]) for key, n, score in first))[:20]
    got = registry.queries()["search_name"](spark, sf_dir).collect()
    assert [(r["k_score"], r["k_length"], r["k_span"], r["k_position"], r["id"]) for r in got] == final and got


def test_highlight_ranges_against_model(spark, sf_dir):
    got = {r["name"]: r["ranges"] for r in registry.queries()["highlight_ranges"](spark, sf_dir).collect()}
    want = {}
    for n in _names(spark, sf_dir):
        low = n.lower()
        places = S.fuzzy(n, "sml")
        if places and "ring" in low:
            mask = [False] * len(n)
            at = [i for i in range(len(n)) if low.startswith("sml", i)]
            for i in [k for a in at for k in range(a, a + 3)] or places[3]:
                mask[i] = True
            for a in range(len(n)):
                if low.startswith("ring", a):
                    mask[a : a + 4] = [True] * 4
            edges = [i for i in range(len(n) + 1) if (i < len(n) and mask[i]) != (i > 0 and mask[i - 1])]
            want[n] = edges
    assert got == want and len(got) > 3


def test_match_alias_against_model(spark, sf_dir):
    from quarry.functions import alias as A

    pattern, want = Q.parse_pattern("srng"), {}
    for n in _names(spark, sf_dir):
        literal = S.pattern_match(n, Q.parse_pattern("'srng"))
        found = []
        for text in (n[0] + n[n.find(" ") + 1], n.replace(" ", "")):
            m = S.pattern_match(text, pattern)
            if m and A.accepts(pattern, text, m):
                span = m[1] - m[0]
                found.append(round(m[2] * 4 / span) if span > 4 else m[2])
        if literal or found:
            want[n] = (literal[2], False) if literal else (max(found), True)
    got = {r["name"]: (r["score"], r["by_alias"]) for r in registry.queries()["match_alias"](spark, sf_dir).collect()}
    assert got == want and got


def test_rank_path_against_model(spark, sf_dir):
    rows = catalog.paths(spark, sf_dir).collect()
    segments, pattern, keyed = [Q.parse_pattern("e"), Q.parse_pattern("_3")], Q.parse_pattern("12"), []
    best = {}
    for r in rows:
        up, name = tuple(r["names"][:-1]), r["name"]
        if up not in best:
            q, score, w = 1, 0, 1.0
            for n in reversed(up):
                m = S.pattern_match(n, segments[q]) if q >= 0 else None
                if m:
                    score, w, q = score + m[2], w * (S.weight(S.marks(n, segments[q])) or 1.0), q - 1
            best[up] = (score, w) if q < 0 else None
        m = S.pattern_match(name, pattern) if best[up] else None
        if m:
            b = m[0]
            at = 0 if b == 0 else (256 if not name[b - 1].isalnum() or name[b - 1].islower() and name[b].isdigit() else 4096) + b
            tail = ((min(r["depth"], 255) << 8) + min(len(name), 255), m[1] - b, at, r["id"])
            keyed.append(((-(m[2] + best[up][0]), *tail), name, m[2], best[up]))
    first = sorted(keyed)[: min(20 * 8 * 5, 4000)]
    final = sorted((-int(score * S.weight(S.marks(name, pattern)) + d * w), *key[1:]) for key, name, score, (d, w) in first)[:20]
    got = registry.queries()["rank_path"](spark, sf_dir).collect()
    assert [(r["k_score"], r["k_length"], r["k_span"], r["k_position"], r["id"]) for r in got] == final and got


def test_path_search_by_alias(spark):
    from quarry.functions import alias as A

    rows = [(1, "重庆", "重庆 report.txt"), (2, "zq", "report.txt"), (3, "北京", "report.txt")]
    df = spark.createDataFrame([(i, n, f"T:/{d}", 2, [d, n], f"T:/{d}/{n}") for i, d, n in rows], "id long, name string, parent_path string, depth int, names array<string>, path string")
    assert {r["id"] for r in H.search_path(df, "zq/report", 10).collect()} == {2}
    assert H.search_path(df, "u:/zq/report", 10).count() == 0 and H.search_path(df, "t/zq/report", 10).count() == 1
    assert {r["id"] for r in H.search_path(df, "zq/report", 10, A.generate).collect()} == {1, 2}


def test_settings_behind_a_keyword(spark):
    from quarry.operators import ranking as R

    rows = spark.createDataFrame([(i, f"Setting {i}") for i in range(20)], "id long, name string")
    count = lambda text: R.keyword_list(rows, text, "set", "name").count()
    assert count("set xyz") == 0 and count("set 1") == 8 and count("set") == 20 and count("other 1") == 0


def test_environment_and_ages(spark):
    from quarry.functions import instant as I

    cases = {"%A%;x": "1;x", "%a%%B%": "12", "50%": "50%", "%%": "%%", "%X%A%": "%X1", "a%B": "a%B", "": "", "%A% %Y% %B%": "1 %Y% 2"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", I.expand_env(F.col("t"), {"A": "1", "b": "2"})).collect()} == cases
    ages = {5: "5s ago", 59: "59s ago", 60: "1m ago", 3599: "59m ago", 3600: "1h ago", 3660: "1h 1m ago", 86400: "1d ago", 93600: "1d 2h ago"}
    df = spark.createDataFrame([(s,) for s in ages], "s long")
    assert {r[0]: r[1] for r in df.select("s", I.age_label(F.col("s"))).collect()} == ages
    ticks = spark.createDataFrame([(133_485_408_000_000_007,), (0,), (-5,)], "f long")
    assert [r[0] for r in ticks.select(I.filetime_seconds(F.col("f"))).collect()] == [1704067200, 0, 0]


def test_fingerprint_refuses_too_many_values(spark, monkeypatch):
    from quarry.operators import aggregates as G

    monkeypatch.setattr(G, "MAX_VALUES", 3)
    assert G.fingerprint(spark.createDataFrame([(x,) for x in ("b", " a", "a ", None, "c")], "v string"), "v").first()[0] == hashlib.sha256(b"a;b;c").hexdigest()
    with pytest.raises(Exception, match="more than 3 values"):
        G.fingerprint(spark.range(9).selectExpr("cast(id as string) v"), "v").collect()


def test_names_are_cut_off_before_they_meet_rows(spark):
    """The first rows by key and id, of names with many rows, ties across names and ties beyond the limit."""
    rng = random.Random(3)
    names = [f"{rng.choice(['bolt', 'blue bolt', 'xbolt', 'a bolt b'])} {rng.choice('abcdef') * rng.randint(1, 2)}" for _ in range(40)]
    rows = spark.createDataFrame([(i, rng.choice(names) if i % 3 else "bolt zz", "k") for i in range(600)], "id long, name string, kind string")
    pattern = Q.parse_pattern("'bolt")
    whole = N.fan_out(N.scored_names(rows, pattern), rows)
    for limit in (1, 3, 30, 250, 599, 2000):
        assert [tuple(r) for r in N.top_rows(rows, pattern, limit).select("id", *N.KEY).collect()] == [tuple(r) for r in N.top(whole, limit).select("id", *N.KEY).collect()]
    scored = N.scored_names(rows, pattern, counts=True)
    for limit in (1, 30, 250):
        kept = N.first_names(scored, limit).collect()
        last = max(tuple(r[k] for k in N.KEY) for r in kept)
        assert sum(r["n_rows"] for r in kept if tuple(r[k] for k in N.KEY) < last) < limit <= sum(r["n_rows"] for r in kept)
    tied = spark.createDataFrame([(i, f"bolt {i % 50:02d}") for i in range(100)], "id long, name string")
    assert [r["id"] for r in N.top_rows(tied, pattern, 5).collect()] == [0, 1, 2, 3, 4]  # all names tie: ids decide
    assert N.top_rows(tied.limit(0), pattern, 5).count() == 0


def test_names_are_salted_by_evidence(spark):
    """Near-unique names go once to the join; a frequent one goes to several tasks, and no row is lost."""
    few = spark.range(2000).select("id", F.concat(F.lit("zz "), F.col("id").cast("string")).alias("name"))
    assert set(N.salts_of(few)) == {1}
    hot = few.unionByName(spark.range(5000, 9000).select("id", F.lit("zz hot").alias("name")))
    salts = N.salts_of(hot)
    assert sum(n > 1 for n in salts) == 1 and max(salts) >= 8
    assert sorted(r["id"] for r in N.fan_out(N.matching_names(hot, Q.parse_pattern("'zz")), hot).collect()) == [*range(2000), *range(5000, 9000)]


def test_sources_of_repeated_rows(spark):
    rows = spark.createDataFrame([("a/b/c", 1), ("a/b/c", 1), ("a/x", 2), ("z", 3), (None, 4)], "path string, source int")
    from quarry.operators.joins import with_source

    got = with_source(rows.select("path", F.col("source").alias("n")), spark.createDataFrame([("a",), ("a/b",), ("a/b",)], "source string"))
    assert sorted(map(tuple, got.collect())) == [("a/b/c", 1, "a/b"), ("a/b/c", 1, "a/b"), ("a/x", 2, "a")]


def test_a_hot_name_is_split(spark):
    """Rows of one name are half of all: no partition of the join holds them all, and none is lost."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 2 == 0, "hot bolt").otherwise(F.concat(F.lit("bolt "), F.col("id").cast("string"))).alias("name"))
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = N.fan_out(N.matching_names(rows, Q.parse_pattern("'bolt")), rows)
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 30_000 and max(sizes) < 6_000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_aliases_combine_all_readings(spark, sf_dir):
    """Names follow the whole key and hold characters with several readings, single ones, other letters, or none."""
    got = {r["p_partkey"]: r["aliases"] for r in registry.queries()["alias_generate"](spark, sf_dir).collect()}
    assert got[3] == "he|hu|huo" and got[7].startswith("gBrand#") and got[10] == ""
    assert got[103] == "hzh|hch;huo~zhong~he|huo~zhong~hu|huo~zhong~huo|huo~chong~he|huo~chong~hu|huo~chong~huo"
    assert len(got) == 200
