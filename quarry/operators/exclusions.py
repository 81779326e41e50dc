"""Exclusions and ignore rules: verdicts on directories are told once for each and inherited by all below.

A path is out if a pattern matches it or a directory above it. Patterns are therefore run over the distinct directories,
all of them as one regular expression, the directories that match are joined with those below by their few prefixes, and
rows ask for their parent's verdict and for their own. Exclusion roots are prefixes and need neither.

Paths are compared without regard to case, kind of separator or a separator at the end. A null or blank path is never
excluded or ignored. Rows that repeat each keep their own verdict.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.globs import ANYWHERE, glob_regex
from quarry.functions.instant import normal_path
from quarry.operators.joins import prefixes

_LOG = logging.getLogger(__name__)


def _plain(path: str) -> str:
    """As normal_path(), of a text."""
    return path.strip().strip('"').replace("\\", "/").rstrip("/") or "/"


def parent_of(path: Column) -> Column:
    """The path without its last part; null at the top."""
    return F.nullif(F.left(path, F.greatest(F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1, F.lit(0))), F.lit(""))


def _single(path: Column) -> Column:
    """Normal, and with one separator between parts."""
    own = normal_path(path)
    return F.when(F.contains(own, F.lit("//")), F.regexp_replace(own, "/+", "/")).otherwise(own)


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def under(path: Column, roots: Iterable[str]) -> Column:
    """Is a path one of the roots or below one? Both may be written with either separator and with one at the end."""
    own = F.lower(normal_path(path))
    return F.coalesce(any_of((own == r) | own.startswith(f"{r}/") for r in (_plain(r).lower() for r in roots if r.strip())), F.lit(False))


@dataclass(frozen=True)
class ExclusionRules:
    """Exclusion roots, globs and regular expressions, as far as they are valid; the others are in skipped."""

    roots: tuple[str, ...]
    globs: tuple[str, ...]
    regexes: tuple[str, ...]
    skipped: tuple[str, ...]
    top: str = ""

    @staticmethod
    def of(spark: SparkSession, roots: Sequence[str] = (), globs: Sequence[str] = (), regexes: Sequence[str] = (), top: str = "") -> ExclusionRules:
        """Patterns that can't be read are left out and logged. Globs are also matched relative to `top`, below which the
        catalog lies; roots outside it are dropped."""
        kept, skipped = {"glob": [], "regex": []}, []
        compile_ = spark.sparkContext._jvm.java.util.regex.Pattern.compile
        for kind, patterns in (("glob", globs), ("regex", regexes)):
            for p in (p.strip() for p in patterns):
                if not p:
                    continue
                try:
                    text = glob_regex(p) if kind == "glob" else p
                    compile_(text)
                    kept[kind].append(text)
                except Exception as error:  # noqa: BLE001 - glob_regex raises ValueError, the JVM its own
                    skipped.append(p)
                    _LOG.warning("%s %r is left out: %s", kind, p, str(error).splitlines()[0])
        base = _plain(top) if top.strip() else ""
        inside = [r for r in map(_plain, (r for r in roots if r.strip())) if not base or r.lower() == base.lower() or r.lower().startswith(f"{base.lower()}/")]
        return ExclusionRules(tuple(inside), tuple(kept["glob"]), tuple(kept["regex"]), tuple(skipped), base)

    def lifted(self, exempt: str | None) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """The roots that apply when a search is aimed at `exempt`, and those that apply to what is below them but not to
        themselves. A root that holds the exempt one, or is it, is lifted."""
        if not exempt:
            return self.roots, ()
        e = _plain(exempt).lower()
        left = [r for r in self.roots if not (e == r.lower() or e.startswith(f"{r.lower()}/"))]
        inner = [r for r in left if r.lower().startswith(f"{e}/")]
        return tuple(r for r in left if r not in inner), tuple(inner)

    def by_root(self, path: Column, exempt: str | None = None) -> Column:
        whole, below = self.lifted(exempt)
        own = F.lower(normal_path(path))
        return under(path, whole) | F.coalesce(any_of(own.startswith(f"{r.lower()}/") for r in below), F.lit(False))

    def by_pattern(self, path: Column) -> Column:
        """Does a glob or regular expression match the path itself? All are one expression."""
        own = normal_path(path)
        name = F.substring_index(own, "/", -1)
        relative = F.when(F.lower(own).startswith(f"{self.top.lower()}/"), F.substring(own, len(self.top) + 2, 1 << 30)).otherwise(own) if self.top else own
        tests = []
        # a glob of one part is asked of the name, which is shorter; those of several of the path
        of_name = [f"^{g.removeprefix(ANYWHERE)}" for g in self.globs if g.startswith(ANYWHERE)]
        of_path = [g for g in self.globs if not g.startswith(ANYWHERE)]
        if of_name:
            tests.append(name.rlike(_either(of_name)))
        if of_path:
            each = _either(of_path)
            tests += [own.rlike(each)] + ([relative.rlike(each)] if self.top else [])
        if self.regexes:
            each = _either(self.regexes)
            tests += [name.rlike(each), own.rlike(each), F.replace(own, F.lit("/"), F.lit("\\")).rlike(each)] + ([relative.rlike(each)] if self.top else [])
        return F.coalesce(any_of(tests), F.lit(False)) & (F.trim(path) != "")


def _either(regexes: Sequence[str]) -> str:
    return "(?i)" + "|".join(f"(?:{r})" for r in regexes)


def inherited(rows: DataFrame, own: Callable[[DataFrame], DataFrame], path_col: str = "path", flag: str = "inherited") -> DataFrame:
    """Rows with whether a directory above is marked. own: takes distinct directories (column `directory`) and returns those
    that are marked by themselves.

    Rows are dealt by parent only where the directories that hide something are too many to be sent to all tasks, which
    the planner measures; a folder with a large part of all rows is then split, as they are on the larger side of the join."""
    parent = parent_of(_single(F.col(path_col)))
    parents = rows.select(parent.alias("_parent")).where("_parent is not null").distinct()
    each = parents.select("_parent", F.explode(prefixes(F.col("_parent"))).alias("directory"))
    marked = own(each.select("directory").distinct()).select("directory")
    hidden = each.join(marked, "directory", "left_semi").groupBy("_parent").agg(F.lit(True).alias(flag))
    met = rows.withColumn("_parent", parent).join(hidden, "_parent", "left")
    return met.select(*rows.columns, F.coalesce(flag, F.lit(False)).alias(flag))


def excluded_rows(rows: DataFrame, rules: ExclusionRules, exempt: str | None = None, path_col: str = "path", name: str = "excluded") -> DataFrame:
    """Rows with whether a rule excludes them: by a root, or by a pattern that matches them or a directory above. An exempt
    root lifts the roots that hold it; patterns apply nevertheless."""
    path = F.col(path_col)
    if not rules.globs and not rules.regexes:
        return rows.withColumn(name, rules.by_root(path, exempt))
    above = inherited(rows, lambda d: d.where(rules.by_pattern(F.col("directory"))), path_col, "_above")
    return above.withColumn(name, rules.by_root(path, exempt) | rules.by_pattern(path) | F.col("_above")).drop("_above")


def surviving(rows: DataFrame, rules: ExclusionRules, bypass: bool = False, exempt: Sequence[str | None] = (), path_col: str = "path") -> DataFrame:
    """The rows that a search shows: all with the bypass, else those that no rule excludes, looked at from each of the exempt
    roots (the folder it is scoped to, the path in its query)."""
    if bypass:
        return rows
    roots_out = [rules.by_root(F.col(path_col), e) for e in (exempt or (None,))]
    by_root = reduce(lambda a, b: a & b, roots_out)
    patterns = ExclusionRules((), rules.globs, rules.regexes, (), rules.top)
    return excluded_rows(rows.where(~by_root), patterns, None, path_col, "_out").where("not _out").drop("_out")


# ---- ignore rules


#: Names of ignore files, in the order in which those of a directory are heard.
IGNORE_NAMES = (".ignore", ".fdignore", ".gitignore")
#: Columns of rules: the directory they lie in ('' is the top), the file's name, their place in it, what they say.
RULES = "directory string, kind string, ordinal int, regex string, keep boolean, dirs_only boolean"


def rule_chains(rules: DataFrame) -> DataFrame:
    """(base, chain): for each directory that has rules, those heard below it, from the top down, as one array."""
    own = rules.groupBy("directory").agg(F.sort_array(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, IGNORE_NAMES)), F.col("kind")).alias("kind"), "ordinal", F.length("directory").alias("skip"), "regex", "keep", "dirs_only"))).alias("rules"))
    bases = own.select(F.col("directory").alias("base"))
    above = bases.select("base", F.explode(F.when(F.col("base") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), prefixes(F.col("base"))))).alias("directory"))
    heard = above.join(own, "directory").groupBy("base").agg(F.sort_array(F.collect_list(F.struct(F.length("directory").alias("n"), "rules"))).alias("x"))
    return heard.select("base", F.flatten(F.col("x.rules")).alias("chain"))


def _judged(paths: DataFrame, chains: DataFrame, path: str, is_dir: Column) -> DataFrame:
    """paths (distinct) with `ignored`: the last rule that matches decides, of those of the directories above. Each path looks
    for the deepest directory above it that has rules, by its prefixes, and gets that one's whole chain."""
    top = F.array(F.lit(""))
    parent = parent_of(F.col(path))
    each = paths.select(path, F.explode(F.when(parent.isNull(), top).otherwise(F.concat(top, prefixes(parent)))).alias("base"))
    nearest = each.join(chains, "base").groupBy(path).agg(F.max_by("chain", F.length("base")).alias("chain"))
    relative = lambda r: F.when(r["skip"] == 0, F.col(path)).otherwise(F.substring(F.col(path), r["skip"] + 2, F.length(path)))
    hits = lambda r: F.rlike(relative(r), F.concat(F.lit("(?i)"), r["regex"])) & (~r["dirs_only"] | is_dir)
    verdict = F.aggregate("chain", F.lit(False), lambda now, r: F.when(hits(r), ~r["keep"]).otherwise(now))
    return paths.join(nearest, path, "left").withColumn("ignored", F.coalesce(verdict, F.lit(False))).drop("chain")


def ignored_by(rows: DataFrame, rules: DataFrame, path_col: str = "path", is_dir: str | None = None) -> DataFrame:
    """Rows with `ignored`, as a walk would meet them: a directory that is ignored isn't entered, so that all below it is
    ignored too, whatever rules deeper down say. rules: see RULES; '' is the top. Without is_dir, rows are files."""
    chains = rule_chains(rules)
    above = inherited(rows, lambda d: _judged(d, chains, "directory", F.lit(True)).where("ignored"), path_col, "_above")
    key = [path_col, *([is_dir] if is_dir else [])]
    own = rows.select(*key).distinct()
    # a path may be there as a file and as a directory
    tagged = own.select(*key, F.struct(_single(F.col(path_col)).alias("p"), (F.coalesce(is_dir, F.lit(False)) if is_dir else F.lit(False)).alias("d")).alias("_k"))
    told = [_judged(tagged.where(F.col("_k.d") == d).select(F.col("_k.p").alias("_p")).distinct(), chains, "_p", F.lit(d)).select("_p", F.lit(d).alias("_d"), F.col("ignored").alias("_own")) for d in ((True, False) if is_dir else (False,))]
    verdicts = reduce(DataFrame.unionByName, told).where("_own")
    met = above.withColumns({"_p": _single(F.col(path_col)), "_d": F.coalesce(is_dir, F.lit(False)) if is_dir else F.lit(False)}).join(verdicts, ["_p", "_d"], "left")
    return met.select(*rows.columns, (F.col("_above") | F.coalesce("_own", F.lit(False))).alias("ignored"))


def walked(rows: DataFrame, rules: DataFrame | None = None, exclusions: ExclusionRules | None = None, max_depth: int = 0, path_col: str = "path", is_dir: str | None = None) -> DataFrame:
    """The rows that a walk lists: none that is ignored or excluded or below such a directory, and none more than max_depth
    directories down, if that isn't 0; a directory at that depth is listed, and what is in it."""
    kept = rows
    if max_depth > 0:
        kept = kept.where(F.size(F.split(normal_path(F.col(path_col)), "/")) <= max_depth + 1)
    if exclusions is not None:
        kept = excluded_rows(kept, exclusions, None, path_col, "_out").where("not _out").drop("_out")
    return kept if rules is None else ignored_by(kept, rules, path_col, is_dir).where("not ignored").drop("ignored")
