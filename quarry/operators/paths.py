"""Path operators over materialised ancestor arrays."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import predicates as P
from quarry.functions import query as Q
from quarry.functions import scoring as S
from quarry.operators import search as N


def positional_match(names: Column, segments: list[str]) -> Column:
    """Are all query segments met right to left, gaps allowed, by a row's ancestor names (root first)?"""
    state = F.lit(len(segments))
    step = lambda left, name: left - F.when(left > 0, segment_hit(name, left, segments)).otherwise(0)
    return F.aggregate(F.reverse(names), state, step) == 0


def segment_hit(name: Column, left: Column, segments: list[str]) -> Column:
    out = F.lit(0)
    for i, s in enumerate(segments):
        out = F.when((left == i + 1) & P.pattern_column(name, Q.parse_pattern(s)), 1).otherwise(out)
    return out


def directory_scores(dirs: DataFrame, segments: list[str], aliases: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(parent_path, dir_score, dir_weight) of distinct directories; only matching ones, each scored once.

    A segment that a name doesn't match is tried on the name's aliases, the first hit counting, with no further gate."""
    patterns = [Q.parse_pattern(s) for s in segments]

    def run(batch: pd.Series) -> pd.DataFrame:
        rows = [list(x) for x in batch]
        each = sorted({n for x in rows for n in x})  # names repeat from directory to directory
        scores = [dict(zip(each, S.pattern_matches(each, p))) for p in patterns]
        for found, p in zip(scores, patterns) if aliases else ():
            for n in each:
                if found[n] is None:
                    found[n] = next((m for m in S.pattern_matches(aliases(n), p) if m), None)
        hit = [[n for n in each if found[n]] for found in scores]
        shares = [dict(zip(names, S.weights(names, p))) for names, p in zip(hit, patterns)]
        out = []
        for names in rows:
            q, score, weight = len(patterns) - 1, 0, 1.0
            for name in reversed(names):
                found = scores[q][name] if q >= 0 else None
                if found:
                    score, weight, q = score + found[2], weight * (shares[q][name] or 1.0), q - 1
            out.append((score if q < 0 else 0, weight))
        return pd.DataFrame(out, columns=["dir_score", "dir_weight"])

    kind = T.StructType([T.StructField("dir_score", T.IntegerType()), T.StructField("dir_weight", T.DoubleType())])
    score = F.pandas_udf(run, kind).asNondeterministic()
    hit = positional_match(F.col("up_names"), segments)
    if aliases:  # names beyond ASCII may match by alias alone
        hit = hit | F.exists("up_names", lambda n: n.rlike("[^\\x00-\\x7F]"))
    hit = dirs.where(hit)
    return hit.withColumn("d", score("up_names")).select("parent_path", "d.*").where("dir_score > 0")


def search_path(rows: DataFrame, text: str, limit: int, aliases: Callable[[str], list[str]] | None = None) -> DataFrame:
    """Path-mode search: directory part by position, name part as a pattern; head-room capped at PATH_CAP."""
    parsed = Q.parse_query(text)
    segments = [s for s in parsed.directory.split("/") if s and not s.endswith(":")]
    pattern = Q.parse_pattern(parsed.name)
    if parsed.drive:  # a one-letter first part is a drive
        rows = rows.where(F.lower(F.substring("path", 1, 2)) == f"{parsed.drive}:")
    up = rows.withColumn("up_names", F.slice("names", 1, F.size("names") - 1))
    dirs = directory_scores(up.select("parent_path", "up_names").distinct(), segments, aliases)
    hits = up.join(dirs, "parent_path")
    if pattern.sets:
        hits = N.fan_out(N.scored_names(rows, pattern).select("name", "score", "k_span", "k_position"), hits)
    else:
        hits = hits.select("*", F.lit(0).alias("score"), F.lit(65535).alias("k_span"), F.lit(65535).alias("k_position"))
    total = F.col("score") + F.col("dir_score")
    depth_length = F.shiftleft(F.least(F.col("depth"), F.lit(255)), 8) + F.least(F.length("name"), F.lit(255))
    keyed = hits.withColumns({"k_score": -P.clamp16(total), "k_length": depth_length.cast("int")})
    room = min(max(limit, N.LEAST_LIMIT) * N.HEADROOM * N.SCAN_HEADROOM, N.PATH_CAP)
    first = N.top(keyed, room)
    share = S.weight_udf(pattern)("name") if pattern.sets else F.lit(1.0)
    refined = first.withColumn("w", share).withColumn("k_score", -P.clamp16(F.floor(F.col("score") * F.col("w") + F.col("dir_score") * F.col("dir_weight"))))
    return N.top(refined, limit).drop("up_names", "w")


def term_fallback(rows: DataFrame, text: str, limit: int) -> DataFrame:
    """Rows of which each term set is met by the name or an ancestor, at least one by the name, and not all by the name.

    An inverse set is met by any segment that lacks it. Judged on distinct directories and distinct names."""
    sets = Q.parse_pattern(text).sets
    if not 2 <= len(sets) <= 16:
        return rows.limit(0)
    full = (1 << len(sets)) - 1
    bits = lambda name: sum((F.when(P.set_column(name, s), 1 << i).otherwise(0) for i, s in enumerate(sets)), F.lit(0))
    names = N.names_of(rows).select("name", bits(F.col("name")).alias("name_mask")).where("name_mask <> 0")
    hits = N.fan_out(names, rows)
    up = F.slice("names", 1, F.size("names") - 1)
    dirs = hits.select("parent_path", up.alias("up")).distinct().select("parent_path", F.aggregate("up", F.lit(0), lambda m, n: m.bitwiseOR(bits(n))).alias("dir_mask"))
    both = hits.join(dirs, "parent_path")
    met = both.where((F.col("name_mask").bitwiseOR(F.col("dir_mask")) == full) & (F.col("name_mask") != full))
    return met.orderBy("id").limit(limit)
