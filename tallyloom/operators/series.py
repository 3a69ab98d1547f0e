"""Result tables for trends, rankings and shares."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.columns import clean_number, ref, require
from tallyloom.functions.dates import as_time, period_label, period_start, time_type
from tallyloom.functions.display import display_number
from tallyloom.operators.aggregate import aggregate, aggregation_name, measure
from tallyloom.operators.filters import complete_rows

# --- fixed values: sizes of results -------------------------------------------------------
DEFAULT_LIMIT, LARGEST_LIMIT = 12, 50
LAST_PERIODS = 36
QUARTERS_ABOVE_DAYS, MONTHS_ABOVE_DAYS = 730, 60
TREEMAP_ITEMS, RADAR_ITEMS, FUNNEL_ITEMS = 10, 6, 6
DEFAULT_TOP = 5


def clamp_limit(limit: int | None) -> int:
    return DEFAULT_LIMIT if limit is None else max(1, min(int(limit), LARGEST_LIMIT))


def add_share(shown: DataFrame, value: str = "value", name: str = "percentage") -> DataFrame:
    """Share of the shown total in percent. Only for results that a limit has made small."""
    total = F.sum(F.abs(ref(value))).over(Window.partitionBy())
    share = F.abs(ref(value)) / F.when(total == 0, F.lit(1.0)).otherwise(total) * 100
    return shown.withColumn(name, F.round(share, 1))


def _present(shown: DataFrame, format_type: str | None, unit: str | None) -> DataFrame:
    return add_share(shown).withColumn(
        "formatted_value", display_number(F.col("value"), format_type, unit)
    )


def category_series(
    df: DataFrame,
    dimension: str,
    metric: str,
    func: str = "auto",
    limit: int | None = DEFAULT_LIMIT,
    sort: str = "descending",
    format_type: str | None = None,
    unit: str | None = None,
) -> DataFrame:
    """Ranked groups: (position, name, value, percentage, formatted_value). Rows with a gap in
    either column are left out; equal values are ordered by name."""
    require(df, dimension, metric)
    narrow = df.select(ref(dimension).alias("name"), ref(metric).alias(f"_{metric}"))
    func = aggregation_name(func, metric)
    groups = aggregate(complete_rows(narrow, narrow.columns), f"_{metric}", func, ["name"])
    rank = F.asc("value") if sort == "ascending" else F.desc("value")
    top = groups.orderBy(rank, "name").limit(clamp_limit(limit))
    place = F.row_number().over(Window.orderBy(rank, "name"))
    shown = top.select(
        place.cast("int").alias("position"), F.col("name").cast("string").alias("name"),
        clean_number(F.col("value")).alias("value"),
    )
    return _present(shown, format_type, unit)


def top_n(
    df: DataFrame, dimension: str, metric: str, n: int = DEFAULT_TOP, direction: str = "top",
    func: str = "auto",
) -> DataFrame:
    """The n best or worst groups."""
    order = "descending" if direction == "top" else "ascending"
    return category_series(df, dimension, metric, func, n, order)


def treemap_items(df: DataFrame, dimension: str, metric: str, func: str = "auto",
                  limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    items = category_series(df, dimension, metric, func, min(clamp_limit(limit), TREEMAP_ITEMS))
    return items.select("position", "name", F.col("value").alias("size"), "value", "percentage")


def radar_items(df: DataFrame, dimension: str, metric: str, func: str = "auto",
                limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Each value as a percentage of the largest shown."""
    items = category_series(df, dimension, metric, func, min(clamp_limit(limit), RADAR_ITEMS))
    largest = F.max("value").over(Window.partitionBy())
    scaled = F.col("value") / F.when(largest == 0, F.lit(1.0)).otherwise(largest) * 100
    return items.select("position", F.col("name").alias("subject"),
                        F.round(scaled, 1).alias("scaled"), "value",
                        F.lit(100).alias("full_mark"))


def funnel_stages(df: DataFrame, dimension: str, metric: str, func: str = "auto",
                  limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    return category_series(df, dimension, metric, func, min(clamp_limit(limit), FUNNEL_ITEMS))


def _grain(first: Column, last: Column) -> Column:
    days = F.timestamp_diff("DAY", first.cast("timestamp_ntz"), last.cast("timestamp_ntz"))
    return (
        F.when(days > QUARTERS_ABOVE_DAYS, "quarter")
        .when(days > MONTHS_ABOVE_DAYS, "month")
        .otherwise("week")
    )


def period_values(
    df: DataFrame, date: str, metric: str, func: str = "sum", by: list[str] | None = None
) -> DataFrame:
    """One value per period (and group): (by, period_start, grain, value). The grain follows the
    span of dates in the whole table. Periods without rows are absent."""
    by = list(by or [])
    require(df, date, metric, *by)
    func = aggregation_name(func, metric)
    moment, kind = as_time(df, date), time_type(df, date)
    narrow = df.select(*[ref(b) for b in by], moment.alias("_moment"), ref(metric).alias("_metric"))
    narrow = narrow.filter(F.col("_moment").isNotNull())
    grain = narrow.agg(
        _grain(F.min("_moment"), F.max("_moment")).alias("grain")
    ).scalar()
    start = (
        F.when(grain == "quarter", period_start(F.col("_moment"), "quarter", kind))
        .when(grain == "month", period_start(F.col("_moment"), "month", kind))
        .otherwise(period_start(F.col("_moment"), "week", kind))
    )
    placed = narrow.withColumn("period_start", start)
    found = aggregate(placed, "_metric", func, [*by, "period_start"])
    return found.select(*[ref(b) for b in by], "period_start", grain.alias("grain"), "value")


def period_series(
    df: DataFrame,
    date: str,
    metric: str,
    func: str = "sum",
    last: int = LAST_PERIODS,
    format_type: str | None = None,
    unit: str | None = None,
) -> DataFrame:
    """The last periods in time order: (position, period_start, name, value, percentage,
    formatted_value)."""
    found = period_values(df, date, metric, func)
    newest = found.orderBy(F.desc("period_start")).limit(last)
    place = F.row_number().over(Window.orderBy("period_start"))
    shown = newest.select(
        place.cast("int").alias("position"), "period_start",
        period_label(F.col("period_start"), F.col("grain")).alias("name"),
        clean_number(F.col("value")).alias("value"),
    )
    return _present(shown, format_type, unit)


def leading_item(shown: DataFrame, value: str = "value") -> DataFrame:
    """Of a small result: the first item with the largest value, the total, and the share."""
    best = F.max_by(F.struct("name", value), F.struct(F.col(value), -F.col("position")))
    return shown.agg(
        best.alias("best"), F.sum(value).alias("total"), F.count(F.lit(1)).cast("bigint").alias("items"),
        F.sum(F.abs(ref(value))).alias("_all"),
    ).select(
        F.col("best.name").alias("name"), F.col(f"best.{value}").alias("value"),
        display_number(F.col(f"best.{value}")).alias("formatted_value"),
        F.round(F.try_divide(F.abs(F.col(f"best.{value}")) * 100, F.col("_all")), 1)
        .alias("percentage"),
        F.round("total", 2).alias("total"), "items",
    )


def leading_rows(shown: DataFrame, n: int = 3) -> DataFrame:
    """The first rows of a result, by position."""
    return shown.orderBy("position").limit(n)


def compare_metrics(
    df: DataFrame, dimension: str, first: str, second: str, func: str = "auto",
    limit: int | None = DEFAULT_LIMIT,
) -> DataFrame:
    """Two metrics over one dimension from one grouping, ranked by the first."""
    require(df, dimension, first, second)
    funcs = [aggregation_name(func, m) for m in (first, second)]
    if "median" in funcs:
        raise ValueError("Compare medians with two calls of category_series.")
    groups = df.filter(ref(dimension).isNotNull()).groupBy(ref(dimension).alias("name")).agg(*[
        measure(f, ref(m)).alias(a)
        for f, m, a in zip(funcs, (first, second), ("first_value", "second_value"))
    ])
    top = groups.orderBy(F.desc("first_value"), "name").limit(clamp_limit(limit))
    return top.select(F.col("name").cast("string").alias("name"),
                      clean_number(F.col("first_value")).alias("first_value"),
                      clean_number(F.col("second_value")).alias("second_value"))


def period_change(
    df: DataFrame, date: str, metric: str, months_back: int, by: list[str] | None = None
) -> DataFrame:
    """Monthly totals and their change against the month ``months_back`` earlier: 1 month over
    month, 12 year over year. A missing month counts as missing, it is not skipped."""
    by = list(by or [])
    require(df, date, metric, *by)
    moment, kind = as_time(df, date), time_type(df, date)
    months = (
        df.select(*[ref(b) for b in by], period_start(moment, "month", kind).alias("period_start"),
                  ref(metric).alias("_metric"))
        .filter(F.col("period_start").isNotNull())
        .groupBy(*[ref(b) for b in by], "period_start")
        .agg(F.coalesce(F.sum("_metric"), F.lit(0)).alias("value"))
    )
    number = F.year("period_start") * 12 + F.month("period_start")
    earlier = (
        Window.partitionBy(*[ref(b) for b in by]).orderBy("_month")
        .rangeBetween(-months_back, -months_back)
    )
    compared = months.withColumn("_month", number).withColumn(
        "previous", F.first("value").over(earlier)
    )
    change = F.try_divide(F.col("value") - F.col("previous"), F.abs("previous")) * 100
    return compared.select(
        *[ref(b) for b in by], "period_start", F.round("value", 2).alias("value"),
        F.round("previous", 2).alias("previous"), F.round(change, 2).alias("change_pct"),
    )


def month_totals(df: DataFrame, date: str, metric: str, limit: int = 12) -> DataFrame:
    """Totals by month name and year, the earliest months first."""
    require(df, date, metric)
    moment = as_time(df, date)
    named = df.select(F.date_format(moment.cast("date"), "MMM yyyy").alias("name"),
                      moment.alias("_moment"), ref(metric).alias("_metric"))
    totals = named.filter(F.col("name").isNotNull()).groupBy("name").agg(
        F.min("_moment").alias("_first"), F.coalesce(F.sum("_metric"), F.lit(0)).alias("value")
    )
    first = totals.orderBy("_first").limit(limit)
    place = F.row_number().over(Window.orderBy("_first")).cast("int")
    return first.select(place.alias("position"), "name", F.round("value", 2).alias("value"))


def latest_entries(df: DataFrame, key: list[str], order_by: list[str], n: int = 20) -> DataFrame:
    """The newest n rows per key. Each task first keeps its own n per key, so a key with many
    rows does not travel whole."""
    require(df, *key, *order_by)
    newest = Window.partitionBy(*[ref(k) for k in key]).orderBy(
        *[ref(c).desc() for c in order_by]
    )
    ranked = df.withColumn("_rank", F.row_number().over(newest))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")
