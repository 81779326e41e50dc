"""Exclusions, ignore rules and path-keyed changes against walks and replays in Python."""

import fnmatch
import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import exclusions as E
from quarry.operators import maintenance as M
from quarry.sources.ignorefiles import rules_frame


def rows_of(spark, paths):
    return spark.createDataFrame([(p, d, "x") for p, d in paths], "path string, is_dir boolean, directory string")


def out_of(spark, paths, exempt=None, **rules):
    df = rows_of(spark, [(p, False) for p in paths])
    return {r["path"] for r in E.excluded_rows(df, E.ExclusionRules.of(spark, **rules), exempt).where("excluded").collect()}


def test_roots_in_any_spelling(spark):
    paths = ["P:/Brand#3/a", "p:\\brand#3\\b\\c", "P:/Brand#3", "P:/Brand#33/a", "Q:/x", "", None, " "]
    for root in ("P:/Brand#3", "P:/Brand#3/", "P:\\Brand#3", 'P:\\Brand#3\\', '"p:/BRAND#3/"'):
        assert out_of(spark, paths, roots=[root, " "]) == {"P:/Brand#3/a", "p:\\brand#3\\b\\c", "P:/Brand#3"}
    assert out_of(spark, paths, roots=["Q:/x", "P:/Brand#3"], top="q:/") == {"Q:/x"}  # roots outside the catalog are dropped


def test_exempt_root_lifts_roots_that_hold_it(spark):
    roots, paths = ["m.x", "m.x/sub", "n/a"], ["m.x/fr/1", "m.x/sub", "m.x/sub/1", "m.x/en/2", "n/a/1", "o"]
    assert out_of(spark, paths, None, roots=roots) == set(paths) - {"o"}
    # aimed at m.x: that root is lifted; what is below m.x/sub stays out, but not m.x/sub itself; a glob applies as ever
    assert out_of(spark, paths, "M.X/", roots=roots, globs=["**/fr/**"]) == {"m.x/fr/1", "m.x/sub/1", "n/a/1"}
    assert out_of(spark, paths, "m.x/sub/1", roots=roots) == {"n/a/1"}
    rules = E.ExclusionRules.of(spark, roots=roots)
    df = rows_of(spark, [(p, False) for p in paths])
    shown = lambda **k: {r["path"] for r in E.surviving(df, rules, **k).collect()}
    assert shown() == {"o"} and shown(bypass=True) == set(paths)
    assert shown(exempt=("m.x/en", "n")) == {"m.x/fr/1", "m.x/en/2", "n/a", "o"} & set(paths)


def test_bad_patterns_are_skipped_and_told(spark, caplog):
    rules = E.ExclusionRules.of(spark, globs=["[a", "tmp", " ", "{x"], regexes=["(", "^7", "*"])
    assert rules.skipped == ("[a", "{x", "(", "*") and len(caplog.records) == 4
    df = rows_of(spark, [("a/tmp/x", False), ("b/7z", False), ("7/c", False), ("d", False)])
    assert {r["path"] for r in E.surviving(df, rules).collect()} == {"d"}


def test_directories_hide_what_is_below(spark):
    rng = random.Random(1)
    names = ["a", "b", "tmp", "node_modules", "x.log", "é", "C D"]
    paths = sorted({"/".join(rng.choices(names, k=rng.randint(1, 6))) for _ in range(400)})
    globs = ["tmp", "*.log", "a/b", "**/é/C*"]

    def hit(p):
        s = p.split("/")
        return s[-1] in ("tmp",) or s[-1].endswith(".log") or p == "a/b" or len(s) > 1 and s[-2] == "é" and s[-1].startswith("C")

    want = {p for p in paths if any(hit("/".join(p.split("/")[: k + 1])) for k in range(p.count("/") + 1))}
    got = out_of(spark, paths + paths[:3], globs=globs)
    assert got == want and 50 < len(want) < len(paths)
    rules = E.ExclusionRules.of(spark, globs=globs)
    df = rows_of(spark, [(p, False) for p in paths])
    assert E.excluded_rows(df, rules).count() == len(paths) and E.excluded_rows(df, rules).columns == ["path", "is_dir", "directory", "excluded"]
    assert E.excluded_rows(df.limit(0), rules).count() == 0


def test_patterns_are_run_once_for_each_directory(spark):
    """A million paths below few directories: patterns see the directories, and rows only their own names."""
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(1_000_000, numPartitions=8).select(F.concat(F.lit("d/"), (F.col("id") % 50).cast("string"), F.lit("/e/"), F.col("id").cast("string")).alias("path"))

    def own(d):
        seen.add(d.count())
        return d.where(F.col("directory").rlike("^d/7$"))

    got = E.inherited(rows, own)
    assert got.where("inherited").count() == 20_000 and seen.value == 1 + 50 + 50
    assert rows.rdd.getNumPartitions() == 8


def brute_ignored(files, path, is_dir):
    """As a walk: from the top down, a directory that is ignored isn't entered."""
    s = path.split("/")
    for k in range(1, len(s) + 1):
        own, folder, out = "/".join(s[:k]), k < len(s) or is_dir, False
        for depth in range(k):
            base = "/".join(s[:depth])
            relative = own[len(base) + 1 :] if base else own
            for name in (".ignore", ".fdignore", ".gitignore"):
                for line in files.get((base, name), "").splitlines():
                    keep, rule = line.startswith("!"), line.removeprefix("!")
                    dirs, rule = rule.endswith("/"), rule.strip("/")
                    text = relative if "/" in rule else relative.split("/")[-1]
                    parts, rules = text.split("/"), rule.split("/")
                    if (folder or not dirs) and len(parts) == len(rules) and all(fnmatch.fnmatchcase(a.lower(), b.lower()) for a, b in zip(parts, rules)):
                        out = not keep
        if out:
            return True
    return False


@pytest.mark.parametrize("seed", range(4))
def test_ignore_rules_as_a_walk_meets_them(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "build", "x.log", "y.txt", "Keep"]
    lines = ["build/", "*.log", "!x.log", "/a", "!a/b", "b/*.txt", "keep", "!build", "a/build/", "# no", "", "*", "!*.txt"]
    files = {(d, n): "\n".join(rng.choices(lines, k=rng.randint(1, 4))) for d in ("", "a", "b", "a/b", "a/build") for n in (".ignore", ".fdignore", ".gitignore") if rng.random() < 0.5}
    plain = {k: "\n".join(x for x in v.splitlines() if x and not x.startswith("#")) for k, v in files.items()}
    paths = sorted({("/".join(rng.choices(names, k=rng.randint(1, 4))), rng.random() < 0.3) for _ in range(200)})
    rules = rules_frame(spark, [(d, n, t) for (d, n), t in files.items()])
    got = E.ignored_by(rows_of(spark, paths), rules, is_dir="is_dir")
    assert got.columns == ["path", "is_dir", "directory", "ignored"]
    assert {(r["path"], r["is_dir"]): r["ignored"] for r in got.collect()} == {(p, d): brute_ignored(plain, p, d) for p, d in paths}
    assert got.count() == len(paths)


def test_what_is_below_an_ignored_directory(spark):
    paths = ["a/build/x.o", "a/build/keep.o", "build", "a/src/x.o"]
    for line in ("build", "build/"):
        rules = rules_frame(spark, [("", ".gitignore", f"{line}\n"), ("a/build", ".gitignore", "!keep.o\n")])
        got = {r["path"]: r["ignored"] for r in E.ignored_by(rows_of(spark, [(p, False) for p in paths]), rules).collect()}
        assert got == {"a/build/x.o": True, "a/build/keep.o": True, "build": line == "build", "a/src/x.o": False}
    none = rules_frame(spark, [])
    df = rows_of(spark, [("a", False), (None, False), ("a", False)])
    assert [r["ignored"] for r in E.ignored_by(df, none).collect()] == [False] * 3 and E.ignored_by(df.limit(0), none).count() == 0


def replay(base, changes, excluded, listing):
    """One record after another over a dictionary."""
    now = dict(base)

    def remove(p):
        for q in [q for q in now if q == p or q.startswith(p + "/")]:
            del now[q]

    def add(p, is_dir, size):
        if excluded(p):
            return remove(p)
        s = p.split("/")
        for k in range(1, len(s)):
            now.setdefault("/".join(s[:k]), (True, 0))
        now[p] = (is_dir, 0 if is_dir else size)

    for path, is_dir, size, action, _ in sorted(changes, key=lambda c: (c[4], c[3] == "add")):
        if action == "remove":
            remove(path)
        else:
            add(path, is_dir, size)
            if is_dir and not excluded(path):
                for q, v in sorted(listing.items()):
                    if q.startswith(path + "/"):
                        add(q, *v)
    return now


PATHS = "path string, is_dir boolean, size long"


@pytest.mark.parametrize("seed", range(6))
def test_path_changes_in_order(spark, seed):
    rng = random.Random(seed)
    base = {f"a/{i % 4}/{i}": (False, i) for i in range(40)} | {"a": (True, 0), **{f"a/{k}": (True, 0) for k in range(4)}}
    listing = {f"a/{k}/{i}": (False, 900 + i) for k in range(3) for i in range(4)} | {"b/1/in": (False, 5), "a/7/in": (False, 6), "b/7/in": (False, 6)}
    some = lambda: "/".join([rng.choice("ab"), str(rng.randint(0, 4)), str(rng.randint(0, 12)), "deep"][: rng.choice([1, 2, 2, 3, 3, 3, 4])])
    changes = []
    for u in range(50):
        p, is_dir = some(), rng.random() < 0.25
        changes.append((p, is_dir, u, rng.choice(["add", "add", "remove"]), u))
        if rng.random() < 0.2:  # a rename has both of its records at one offset
            changes.append((some(), False, u, "remove" if changes[-1][3] == "add" else "add", u))
    bad = lambda p: p.split("/")[-1] == "7"
    seen = {}  # no two adds of a path at one offset, whose order nothing would tell
    changes = [c for c in changes if seen.setdefault((c[0], c[4], c[3]), c) is c]
    got = M.apply_path_changes(
        spark.createDataFrame([(p, *v) for p, v in base.items()], PATHS), spark.createDataFrame(changes, f"{PATHS}, action string, usn long"),
        lambda rows: rows.where("path rlike '(^|/)7$'"), spark.createDataFrame([(p, *v) for p, v in listing.items()], PATHS),
    )
    assert got.columns == ["path", "is_dir", "size"]
    assert {r["path"]: (r["is_dir"], r["size"]) for r in got.collect()} == replay(base, changes, bad, listing) and got.count() == len({r["path"] for r in got.collect()})


def test_path_changes_around_a_directory(spark):
    base = spark.createDataFrame([("d", True, 0), ("d/x", False, 1), ("e\\y\\", False, 2), (None, False, 3), ("e/y", False, 1)], PATHS)

    def after(*changes):
        df = spark.createDataFrame([(p, d, 7, a, u) for u, (p, d, a) in enumerate(changes)], f"{PATHS}, action string, usn long")
        return {r["path"]: (r["is_dir"], r["size"]) for r in M.apply_path_changes(base, df).collect()}

    assert after() == {"d": (True, 0), "d/x": (False, 1), "e/y": (False, 2)}
    assert after(("d/y", False, "add"), ("d", True, "remove")) == {"e/y": (False, 2)}
    assert after(("d", True, "remove"), ("d", True, "add")) == {"d": (True, 0), "e/y": (False, 2)}
    assert after(("d", True, "remove"), ("D2/n/z", False, "add"), ("d/z", False, "add")) == {"d": (True, 0), "d/z": (False, 7), "D2": (True, 0), "D2/n": (True, 0), "D2/n/z": (False, 7), "e/y": (False, 2)}


def test_listed_directories_that_are_added_often(spark):
    """A directory's listing counts once, however often the journal adds it: 20,000 records by 20,000 paths are no product."""
    began = time.time()
    listing = spark.range(20_000).selectExpr("concat('a/b/', id) AS path", "false AS is_dir", "2L AS size")
    journal = spark.range(20_001).selectExpr("'a/b' AS path", "id < 20000 AS is_dir", "if(id < 20000, 'add', 'remove') AS action", "1L AS size", "if(id < 20000, id, 19998L) AS usn")
    base = spark.createDataFrame([("a/b/old", False, 7)], "path string, is_dir boolean, size long")
    got = M.apply_path_changes(base, journal, None, listing)
    assert {tuple(r) for r in got.groupBy("is_dir", "size").count().collect()} == {(True, 0, 2), (False, 2, 20_000)}
    assert time.time() - began < 60
