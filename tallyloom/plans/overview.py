"""Key figures and the default set of results for a table."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import clean_number, ref, require
from tallyloom.functions.display import display_number
from tallyloom.operators.aggregate import aggregation_name, default_aggregation, measure
from tallyloom.operators.distribution import first_pairs, histogram, scatter_pairs
from tallyloom.operators.ordered import percentiles
from tallyloom.operators.profiling import column_roles, profile
from tallyloom.operators.quality import quality_score
from tallyloom.operators.series import category_series, period_series


def key_figures(
    df: DataFrame, metric: str, func: str = "auto", second: str | None = None,
    second_func: str = "auto", quality: DataFrame | None = None,
    format_type: str | None = None, unit: str | None = None,
) -> DataFrame:
    """One row: title, value, formatted_value, aggregation, second_kpi, second_value, total_rows,
    data_quality. All measures come from one aggregate; a median adds its own pass."""
    require(df, metric, *([second] if second else []))
    chosen = aggregation_name(func, metric)

    def value(name, how):
        if how == "median":
            found = percentiles(df, name, [0.5])
            return F.first(found.select(F.get("quantiles", F.lit(0)).alias("m")).scalar())
        return measure(how, ref(name))

    figures = {"value": value(metric, chosen), "total_rows": F.count(F.lit(1))}
    if second:
        figures["second_value"] = value(second, aggregation_name(second_func, second))
    found = df.agg(*[e.alias(k) for k, e in figures.items()])
    averaged = chosen == "mean" and default_aggregation(metric) == "mean"
    number = clean_number(F.col("value"))
    return found.select(
        F.lit(f"Avg {metric}" if averaged else metric).alias("title"), number.alias("value"),
        display_number(number, format_type, unit).alias("formatted_value"),
        F.lit(chosen).alias("aggregation"), F.lit(second).cast("string").alias("second_kpi"),
        (clean_number(F.col("second_value")) if second else F.lit(None).cast("double"))
        .alias("second_value"),
        "total_rows",
        (quality.scalar() if quality is not None else F.lit(100.0)).alias("data_quality"),
    )


def overview(
    df: DataFrame, roles: dict[str, list[str]] | None = None, scatter_order: list[str] | None = None
) -> DataFrame:
    """The default results of a table as one long table (result, position, name, value, share):
    trend, breakdown, share, histogram, and scatter or second breakdown. ``roles`` come from the
    profile when not given. Each result reads only its own columns."""
    roles = roles or column_roles(profile(df, medians=False))
    metric = (roles["kpis"] or [None])[0]
    dates, categories, numbers = roles["dates"], roles["categories"], roles["numbers"]
    func = default_aggregation(metric or "")
    parts: list[DataFrame] = []

    def add(name: str, shown: DataFrame, value: str = "value", share: str | None = "percentage"):
        parts.append(shown.select(
            F.lit(name).alias("result"), F.col("position").cast("int").alias("position"), "name",
            F.col(value).cast("double").alias("value"),
            (F.col(share) if share else F.lit(None).cast("double")).alias("share")))

    if metric and dates:
        add("trend", period_series(df, dates[0], metric, func))
    if metric and categories:
        add("breakdown", category_series(df, categories[0], metric, func))
        second = categories[1] if len(categories) > 1 else categories[0]
        add("share", category_series(df, second, metric, "sum" if func == "sum" else "count"))
    if metric:
        add("histogram", histogram(df, metric), share=None)
    if len(numbers) >= 2:
        x, y = numbers[:2]
        pairs = (first_pairs(df, x, y, scatter_order) if scatter_order
                 else scatter_pairs(df, x, y, [x, y]))
        parts.append(pairs.select(
            F.lit("scatter").alias("result"), "position",
            F.concat("formatted_x", F.lit(" / "), "formatted_y").alias("name"),
            F.col("y").alias("value"), F.lit(None).cast("double").alias("share")))
    elif metric and len(categories) > 1:
        add("second_breakdown", category_series(df, categories[1], metric, func))
    if not parts:
        raise ValueError("The table has no column to measure.")
    return reduce(DataFrame.unionByName, parts)


def summary(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profile, key figures and overview of a table."""
    facts = profile(df)
    roles = column_roles(facts)
    figures = key_figures(df, roles["kpis"][0], quality=quality_score(facts))
    return facts, figures, overview(df, roles)
