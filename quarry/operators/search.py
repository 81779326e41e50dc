"""Name search: match distinct names once, fan out to rows, rank, refine."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import predicates as P
from quarry.functions import query as Q
from quarry.functions import scoring as S

#: Fixed values of two-stage ranking: least limit, head-room, scan head-room, cap in path mode.
LEAST_LIMIT, HEADROOM, SCAN_HEADROOM, PATH_CAP = 8, 8, 5, 4000
#: Groups of names, by hash, for which the rows of the most frequent name are known when rows are dealt out.
GROUPS = 4096


def names_of(rows: DataFrame) -> DataFrame:
    """The name dictionary: distinct names with their character masks and how many rows each has."""
    return rows.groupBy("name").agg(F.count("*").alias("n_rows")).withColumn("mask", P.mask_column(F.col("name")))


def matching_names(rows: DataFrame, pattern: Q.Pattern, dictionary: DataFrame | None = None) -> DataFrame:
    """Distinct names that match; the mask test is native and runs before anything costlier. A stored dictionary (as
    names_of() makes it) spares the distinct."""
    named = names_of(rows) if dictionary is None else dictionary
    return named.where(P.mask_filter(F.col("mask"), pattern)).where(P.pattern_column(F.col("name"), pattern)).drop("mask", "n_rows")


def rank_fields(name: Column, begin: Column, end: Column, score: Column) -> list[Column]:
    """The rank key, ascending: score (descending, so negated), trimmed length, span, position."""
    found = begin >= 0
    return [
        (-P.clamp16(score)).alias("k_score"),
        P.clamp16(F.length(F.trim(name))).alias("k_length"),
        F.when(found, P.clamp16(end - begin)).otherwise(65535).cast("int").alias("k_span"),
        F.when(found, P.position_point(name, begin)).otherwise(65535).cast("int").alias("k_position"),
    ]


KEY = ("k_score", "k_length", "k_span", "k_position")


def scored_names(rows: DataFrame, pattern: Q.Pattern, scheme: str = "default", dictionary: DataFrame | None = None, counts: bool = False) -> DataFrame:
    """Distinct matching names with begin, end, score and rank fields, on demand with their number of rows; Python sees each
    name once."""
    named = names_of(rows) if dictionary is None else dictionary
    likely = named.where(P.mask_filter(F.col("mask"), pattern)).where(P.pattern_column(F.col("name"), pattern))
    hits = likely.withColumn("m", S.match_udf(pattern, scheme)("name")).where("m.score is not null")
    more = ["n_rows"] if counts else []
    return hits.select("name", *more, "m.*").select("name", *more, "begin", "end", "score", *rank_fields(F.col("name"), F.col("begin"), F.col("end"), F.col("score")))


def salts_of(rows: DataFrame, dictionary: DataFrame | None = None) -> list[int]:
    """For each group of names the tasks that its names' rows are dealt to: more than one only where the group holds a name
    with over a quarter of an average task's rows. One number a group comes to the driver."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.groupBy("name").agg(F.count("*").alias("n_rows")) if dictionary is None or "n_rows" not in dictionary.columns else dictionary
    found = named.groupBy(_group().alias("g")).agg(F.max("n_rows").alias("most"), F.sum("n_rows").alias("n")).collect()
    total = sum(r["n"] for r in found) or 1
    salts = [1] * GROUPS
    for r in found:
        salts[r["g"]] = max(1, -(-r["most"] * 4 * parts // total)) if r["most"] * 4 * parts > total and r["most"] > parts else 1
    return salts


def _group() -> Column:
    return F.pmod(F.xxhash64("name"), F.lit(GROUPS)).cast("int")


def fan_out(names: DataFrame, rows: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Rows of the names. The dictionary's size follows the data, so the join strategy is left to its measured size. A name
    can be a third of all rows, and behind a distinct the planner doesn't split a skewed join: rows of names that are
    known to be frequent are dealt by a salt too, and such a (distinct) name goes to each of its salts. Others go once."""
    salts = salts_of(rows, dictionary)
    if max(salts) == 1:
        return rows.join(names, "name")
    few = {g: n for g, n in enumerate(salts) if n > 1}  # groups of frequent names; the rest have one salt
    count = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in few.items() for x in kv)), _group()), F.lit(1))
    own = [c for c in rows.columns if c == "id"] or rows.columns
    each = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*own), count).cast("int")).join(each, ["name", "_salt"]).drop("_salt")


def first_names(names: DataFrame, limit: int) -> DataFrame | None:
    """The names (with n_rows) whose rows can be among the first `limit` by rank key: keys depend on the name alone, so names
    are taken in the order of their keys until their rows fill the limit, and with them all that tie with the last. At most
    limit + 1 names come to the driver; where ties go beyond them, the boundary's key is compared instead."""
    rows = names.orderBy(*KEY, "name").limit(limit + 1).collect()
    key = lambda r: tuple(r[k] for k in KEY)
    total, last = 0, None
    for r in rows:
        total, last = total + r["n_rows"], key(r)
        if total >= limit:
            break
    if last is None:
        return names.limit(0)
    if total >= limit and len(rows) > limit and key(rows[-1]) == last:
        return names.where(F.struct(*KEY) <= F.struct(*(F.lit(v).cast(names.schema[k].dataType).alias(k) for k, v in zip(KEY, last))))
    return names.sparkSession.createDataFrame([r for r in rows if key(r) <= last], names.schema)


def top(rows: DataFrame, limit: int, *more: str) -> DataFrame:
    return rows.orderBy(*KEY, *more, "id").limit(limit)


def top_rows(rows: DataFrame, pattern: Q.Pattern, limit: int, dictionary: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """The first rows by rank key and id. Names are cut off before they meet rows, so that only the rows of a few names are
    looked for and none is shuffled but those. whole: the dictionary, if one is given, counts just these rows."""
    if dictionary is not None and not (whole and "n_rows" in dictionary.columns):
        return top(fan_out(scored_names(rows, pattern, dictionary=dictionary), rows), limit)
    names = first_names(scored_names(rows, pattern, dictionary=dictionary, counts=True), limit).drop("n_rows")
    return top(rows.join(names, "name"), limit)


def favorites(rows: DataFrame, pattern: Q.Pattern) -> DataFrame:
    """Favourites (custom, url, path) whose display name matches: the custom name, else the url, else the path's last part.
    Adds name and weight."""
    shown = rows.withColumn("name", F.coalesce(F.nullif("custom", F.lit("")), F.nullif("url", F.lit("")), F.regexp_extract("path", "([^/]+)/*$", 1)))
    return shown.where(P.pattern_column(F.col("name"), pattern)).withColumn("weight", S.weight_udf(pattern)("name"))


def search(rows: DataFrame, text: str, limit: int, fuzzy: bool = True, alias_forms: Callable[[str], Iterable[str]] | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """Two-stage ranked search: unweighted top with head-room, then scores weighted by coverage, then the limit."""
    pattern = Q.parse_pattern(text, fuzzy, alias_forms)
    if pattern.drive:
        rows = rows.where(F.lower("source_key") == pattern.drive)
    elif not pattern.sets:
        rows = rows.limit(0)
    if not pattern.sets:
        return rows.select(*rows.columns, *(F.lit(0).alias(k) for k in ("begin", "end", "score", *KEY))).orderBy("id").limit(limit)
    room = max(limit, LEAST_LIMIT) * HEADROOM
    first = top_rows(rows, pattern, room, dictionary, whole=not pattern.drive)  # a dictionary counts the rows of all sources
    refined = first.withColumn("w", S.weight_udf(pattern)("name"))
    score = F.when(F.col("w") < 1, F.floor(F.col("score") * F.col("w"))).otherwise(F.col("score"))
    return top(refined.withColumn("k_score", -P.clamp16(score)).drop("w"), limit)
