"""Row filters: comparisons, value filters, time ranges counted from the latest date, and the
values with most rows.

Time ranges are half-open bounds on the bare column. The bounds come from the latest date, one
row found by one small job, so they are literals that reach the Parquet scan as pushed filters and
prune partitions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import as_number, ref, require
from tallyloom.functions.dates import as_time, time_type

_COMPARE = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}
COMPARISONS = ["==", "!=", *_COMPARE]
YEAR_TO_LATEST = ("this_year", "current_year", "latest_year", "ytd")
YEAR_BEFORE = ("last_year", "previous_year")


def comparison(column: Column, op: str, value) -> Column:
    """``!=`` also keeps rows where the column is missing."""
    if op == "==":
        return column == F.lit(value)
    if op == "!=":
        return ~column.eqNullSafe(F.lit(value))
    if op not in _COMPARE:
        raise ValueError(f"Unsupported operator '{op}'.")
    return _COMPARE[op](column, F.lit(value))


def filter_rows(df: DataFrame, column: str, operator: str, value) -> DataFrame:
    require(df, column)
    return df.filter(comparison(ref(column), operator, value))


def filter_report(df: DataFrame, column: str, operator: str, value) -> DataFrame:
    """How many rows ``filter_rows`` keeps and removes, in one pass."""
    require(df, column)
    kept = F.count_if(F.coalesce(comparison(ref(column), operator, value), F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("rows_before"), kept.alias("rows_after")).withColumn(
        "removed", F.col("rows_before") - F.col("rows_after")
    )


def _unless_empty(filtered: DataFrame, df: DataFrame, on_empty: str) -> DataFrame:
    if on_empty not in ("keep", "ignore"):
        raise ValueError("on_empty is 'keep' or 'ignore'.")
    return df if on_empty == "ignore" and filtered.isEmpty() else filtered


def value_condition(df: DataFrame, column: str, operator: str, value) -> Column:
    """Equality compares text without regard to case; ranges compare numbers."""
    if operator in ("==", "!="):
        same = F.lower(ref(column).cast("string")).eqNullSafe(F.lit(str(value).lower()))
        return same if operator == "==" else ~same
    if operator not in _COMPARE:
        raise ValueError(f"Unsupported operator '{operator}'.")
    return _COMPARE[operator](as_number(df, column), F.lit(float(value)))


def value_filters(
    df: DataFrame, filters: list[dict], on_bad: str = "skip", on_empty: str = "keep"
) -> DataFrame:
    """All filters ``{column, operator, value}`` together. Unknown columns, operators and range
    values that are no number are skipped or raised. With ``on_empty='ignore'`` a filter that
    would leave no row is left out, at the price of one small job per filter."""
    conditions = []
    for item in filters:
        try:
            require(df, item.get("column"))
            conditions.append(
                value_condition(df, item["column"], item.get("operator", "=="), item.get("value"))
            )
        except (ValueError, TypeError):
            if on_bad != "skip":
                raise
    if on_empty == "ignore":
        return reduce(lambda kept, c: _unless_empty(kept.filter(c), kept, on_empty), conditions, df)
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def _back(moment: Column, n: int, unit: str) -> Column:
    months = {"month": 1, "quarter": 3, "year": 12}
    if unit in months:
        return moment - F.make_ym_interval(F.lit(0), F.lit(n * months[unit]))
    if unit not in ("week", "day"):
        raise ValueError(f"Unknown unit '{unit}'.")
    return moment - F.make_dt_interval(F.lit(n * (7 if unit == "week" else 1)))


def time_bounds(
    latest: Column, kind: str, n: int = 1, unit: str = "month", year: int | None = None
) -> tuple[Column | None, Column | None]:
    """First moment inside and first moment after, given the latest date of the column."""
    day = latest.cast("date")
    if kind in YEAR_TO_LATEST:
        return F.trunc(day, "year"), None
    if kind in YEAR_BEFORE:
        return _back(F.trunc(day, "year"), 1, "year"), F.trunc(day, "year")
    if kind == "year":
        if year is None:
            raise ValueError("Time filter 'year' needs a year.")
        return F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(
            F.lit(year + 1), F.lit(1), F.lit(1)
        )
    if kind == "last_n":
        return _back(latest, n, unit), None
    if kind == "last_quarter":
        return _back(F.trunc(day, "quarter"), 1, "quarter"), F.trunc(day, "quarter")
    if kind == "this_quarter":
        return F.trunc(day, "quarter"), None
    raise ValueError(f"Unknown time filter '{kind}'.")


def time_filter(
    df: DataFrame,
    column: str,
    kind: str,
    n: int = 1,
    unit: str = "month",
    year: int | None = None,
    on_empty: str = "keep",
) -> DataFrame:
    """Rows in a time range counted back from the latest date in the column, not from today:
    this_year, last_year, year, last_n (day, week, month, quarter, year), last_quarter,
    this_quarter."""
    require(df, column)
    moment, data_type = as_time(df, column), time_type(df, column)
    bounds = time_bounds(F.max(moment), kind, n, unit, year)
    if kind != "year":  # a year is known without looking
        texts = [F.lit(None) if b is None else b.cast(data_type).cast("string") for b in bounds]
        found = df.agg(F.max(moment).isNull().alias("unknown"), F.array(*texts).alias("bounds")).first()
        if found["unknown"]:
            return df
        bounds = [None if b is None else F.lit(b) for b in found["bounds"]]
    condition = F.lit(True)
    for bound, op in zip(bounds, (">=", "<")):
        if bound is not None:
            condition = condition & _COMPARE[op](moment, bound.cast(data_type))
    return _unless_empty(df.filter(condition), df, on_empty)


def parse_date_column(df: DataFrame, column: str) -> DataFrame:
    """The column as points in time, rows without one dropped."""
    require(df, column)
    return df.withColumn(column, as_time(df, column)).filter(ref(column).isNotNull())


def parse_number_column(df: DataFrame, column: str) -> DataFrame:
    """The column as double, rows that hold no number dropped."""
    require(df, column)
    return df.withColumn(column, as_number(df, column)).filter(ref(column).isNotNull())


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in each of the columns."""
    require(df, *columns)
    return df.select(*[ref(c) for c in columns]).na.drop()


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k values with most rows, ties to the smaller value: (column, n)."""
    require(df, column)
    counts = df.filter(ref(column).isNotNull()).groupBy(ref(column)).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.orderBy(F.desc("n"), ref(column)).limit(k)


def keep_top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows whose value is one of the k most frequent; the broadcast side has k rows at most."""
    top = top_values(df, column, k).select(ref(column))
    return df.join(F.broadcast(top), column, "left_semi")
