"""Named queries over the given tables, each with the SQL that must give the same rows."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register the decorated function under its own name."""

    def register(build):
        if build.__name__ in QUERIES:
            raise ValueError(f"Query {build.__name__} is registered twice.")
        QUERIES[build.__name__] = Query(build.__name__, covers, build, sql)
        return build

    return register


def rounded(df: DataFrame, *names: str, places: int = 2) -> DataFrame:
    """Sums of money depend on the order of addition in the last bits; cents do not."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


def sql_display(x: str, before: str = "", after: str = "", percent: bool = False) -> str:
    """``display_number`` as SQL."""
    thousands = "" if percent else (
        f"WHEN abs({x}) >= 1e4 THEN format('{{:.1f}}', {x} / 1e3) || 'K' ")
    return (
        f"CASE WHEN {x} IS NULL THEN '—' ELSE '{before}' || CASE "
        f"WHEN abs({x}) >= 1e9 THEN format('{{:.2f}}', {x} / 1e9) || 'B' "
        f"WHEN abs({x}) >= 1e6 THEN format('{{:.2f}}', {x} / 1e6) || 'M' {thousands}"
        f"WHEN abs({x}) >= 100 OR ({x} = floor({x}) AND abs({x}) >= 1) "
        f"THEN format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT)) "
        f"WHEN abs({x}) < 0.01 AND abs({x}) > 0 THEN format('{{:.4f}}', {x}) "
        f"ELSE format('{{:.2f}}', {x}) END || '{after}' END"
    )


def sql_share(x: str = "value") -> str:
    total = f"sum(abs({x})) OVER ()"
    return f"round(abs({x}) / CASE WHEN {total} = 0 THEN 1 ELSE {total} END * 100, 1)"


def sql_ranked(groups: str, limit: int, ascending: bool = False, display: str | None = None) -> str:
    """``category_series`` as SQL over a query that gives (name, value)."""
    way = "ASC" if ascending else "DESC"
    return f"""
        WITH g AS ({groups}),
        top AS (SELECT name, value, row_number() OVER (ORDER BY value {way}, name) AS p FROM g),
        shown AS (SELECT CAST(p AS INTEGER) AS position, CAST(name AS VARCHAR) AS name,
                         round(value, 4) AS value FROM top WHERE p <= {limit})
        SELECT position, name, round(value, 2) AS value, {sql_share()} AS percentage,
               {display or sql_display('value')} AS formatted_value FROM shown"""
