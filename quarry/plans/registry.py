"""Every registered query with its DuckDB text."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.sources import catalog

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}
_MODULES = ("search", "scope", "ranking", "maintenance", "functions", "stored")


def with_views(sql: str) -> str:
    """DuckDB text with the catalog views that it names in front."""
    used = [v for v in catalog.CTE if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", sql)]
    ctes = ", ".join(f"{v} AS ({catalog.CTE[v]})" for v in used)
    if not ctes:
        return sql
    body = sql.strip()
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}{ctes}, {body[m.end() :]}"
    return f"WITH {ctes} {body}"


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query function under its name."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if oracle is not None:
            _ORACLE[key] = with_views(oracle)
        return f

    return add


def sql_query(name: str, sql: str, oracle: str | None = None) -> None:
    """Registers a query that is one SQL text over views and tables; where dialects differ, with a DuckDB text of its own."""
    used = [v for v in (*catalog.VIEWS, *catalog.TABLES) if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {v: catalog.VIEWS[v](spark, sf_dir) if v in catalog.VIEWS else catalog.table(spark, sf_dir, v) for v in used}
        text = sql.replace("{", "{{").replace("}", "}}")
        for v in used:
            text = re.sub(rf"\b(FROM|JOIN)(\s+){v}\b", rf"\1\2{{{v}}}", text)
        return spark.sql(text, **frames)

    _QUERIES[name] = run
    _ORACLE[name] = with_views(oracle or sql)


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"quarry.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
