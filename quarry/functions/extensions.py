"""Extension surface: registries of providers, and the SQL functions that a session can use.

| provider | shape |
|-|-|
| alias | name -> alternative spellings (an Arrow UDF over distinct names), query term -> forms, with a version (`alias.AliasProvider`) |
| token | (token, rows) -> rows or None; reorders or filters, never adds (`operators.ranking.PROVIDERS`) |
| items | session -> rows of (name, path, weight) |
| instant | query text -> rows, as a table function |
| column | row -> text, as a Column factory |
| filter | rows -> predicate Column |
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import instant
from quarry.functions.alias import AliasProvider
from quarry.functions import query as Q
from quarry.functions import scoring as S


@dataclass
class Extensions:
    aliases: list[AliasProvider] = field(default_factory=list)
    items: list[Callable[..., DataFrame]] = field(default_factory=list)
    instants: list[Callable[[str], Iterator[tuple[str, str]]]] = field(default_factory=list)
    columns: dict[str, Callable[[], Column]] = field(default_factory=dict)
    filters: dict[str, Column] = field(default_factory=dict)

    def query_forms(self, term: str) -> list[str]:
        """Alternative spellings of a query term by all alias providers, for parse_pattern()."""
        return list(dict.fromkeys(f for p in self.aliases for f in p.query_forms(term)))

    def catalog(self, spark: SparkSession, *place: str) -> DataFrame:
        """All item providers' rows; what they need to know beside the session is passed on to each."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f(spark, *place) for f in self.items))

    def filtered(self, rows: DataFrame, groups: list[list[str]]) -> DataFrame:
        """Rows that meet a filter of every group; a name that no provider has filters everything."""
        tests = [reduce(lambda a, b: a | b, (self.filters.get(n, F.lit(False)) for n in names), F.lit(False)) for names in groups]
        return rows.where(reduce(lambda a, b: a & b, tests, F.lit(True)))

    def with_columns(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({name: make() for name, make in self.columns.items()})


def instant_rows(text: str) -> Iterator[tuple[str, str]]:
    """What the evaluators have to say to a query text: (kind, result)."""
    for kind, f in (("calculator", instant.calculate), ("base", instant.convert_base)):
        found = f(text)
        if found is not None:
            yield kind, found


@F.udtf(returnType="kind string, result string")
class InstantResults:
    def eval(self, text: str):
        if text is not None:
            yield from instant_rows(text)


def register(spark: SparkSession) -> None:
    """SQL functions: instant_results(text) as a table, fuzzy_score(name, query) as a scalar."""

    def score(names: pd.Series, texts: pd.Series) -> pd.Series:
        out = pd.Series(pd.array([None] * len(names), "Int32"))
        for text in {t for t in texts if t}:  # each query is parsed once a batch
            at = [i for i, (x, t) in enumerate(zip(names, texts)) if t == text and x is not None]
            for i, m in zip(at, S.pattern_matches([names.iloc[i] for i in at], Q.parse_pattern(text))):
                out.iloc[i] = m[2] if m else None
        return out

    spark.udtf.register("instant_results", InstantResults)
    spark.udf.register("fuzzy_score", F.pandas_udf(score, "int"))
