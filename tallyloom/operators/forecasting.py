"""Linear trend forecasts, for one series or one per group at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.columns import is_time, ref, require
from tallyloom.functions.display import plain_number
from tallyloom.operators.series import LAST_PERIODS, period_values

# --- fixed values: forecast ---------------------------------------------------------------
HORIZON, Z_95, FLAT_SHARE = 4, 1.96, 0.05
QUARTER_GAP, MONTH_GAP, WEEK_GAP = 75, 20, 5
RISING_ABOVE, FALLING_BELOW = 2.0, -2.0


def fit_trend(series: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Least squares over 0, 1, 2, ... per group, gaps left out: (by, n, slope, intercept,
    residual_std, mean, last_at, gap_days). Groups with fewer than two values are dropped. A
    series holds one row per period, so a group is small."""
    by = list(by or [])
    require(series, value, order, *by)
    keys = [ref(b) for b in by]
    group = Window.partitionBy(*keys)
    dated = is_time(series.schema[order].dataType)
    known = series.filter(ref(value).isNotNull()).select(
        *keys, ref(order).alias("_at"), ref(value).cast("double").alias("_y"))
    placed = known.withColumns({
        "_x": (F.row_number().over(group.orderBy("_at")) - 1).cast("double"),
        "_before": F.lag("_at").over(group.orderBy("_at")),
    })
    fitted = placed.withColumns({
        "_slope": F.regr_slope("_y", "_x").over(group),
        "_intercept": F.regr_intercept("_y", "_x").over(group),
    })
    residual = F.col("_y") - (F.col("_slope") * F.col("_x") + F.col("_intercept"))
    ends = F.max_by(F.struct("_at", "_before"), "_x")
    found = fitted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first("_slope").alias("slope"),
        F.first("_intercept").alias("intercept"),
        F.sqrt(F.avg(residual * residual)).alias("_spread"), F.avg("_y").alias("mean"),
        ends.alias("_ends"),
    ).filter(F.col("n") >= 2)
    spread = F.when(F.col("_spread") == 0, F.col("mean") * FLAT_SHARE).otherwise(F.col("_spread"))
    gap = (
        F.greatest(F.date_diff(F.col("_ends._at").cast("date"),
                               F.col("_ends._before").cast("date")), F.lit(1))
        if dated else F.lit(None).cast("int")
    )
    return found.select(*keys, "n", "slope", "intercept", spread.alias("residual_std"), "mean",
                        F.col("_ends._at").alias("last_at"), gap.alias("gap_days"))


def future_label(last_at: Column, gap: Column, step: Column) -> Column:
    """Q3 2024, Jul 2024, Wk of Jul 01, Jul 02 or Period +1, by the distance of the last two
    dates."""
    day = last_at.cast("date")
    quarter = F.add_months(day, step * 3)
    return (
        F.when(gap > QUARTER_GAP, F.concat(
            F.lit("Q"), F.quarter(quarter).cast("string"), F.lit(" "),
            F.year(quarter).cast("string")))
        .when(gap > MONTH_GAP, F.date_format(F.add_months(day, step), "MMM yyyy"))
        .when(gap > WEEK_GAP, F.concat(
            F.lit("Wk of "), F.date_format(F.date_add(day, step * 7), "MMM dd")))
        .otherwise(F.date_format(F.date_add(day, step), "MMM dd"))
    )


def forecast(
    series: DataFrame, value: str = "value", order: str = "period_start",
    by: list[str] | None = None, horizon: int = HORIZON, floor_at_zero: bool = True,
) -> DataFrame:
    """The next periods of each series with a 95 % band: (by, step, period, expected, best_case,
    worst_case)."""
    by = list(by or [])
    fit = fit_trend(series, value, order, by)
    ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    at = F.col("n") - 1 + F.col("step")
    line = F.col("slope") * at + F.col("intercept")
    band = F.lit(Z_95) * F.col("residual_std") * F.sqrt(F.col("step"))
    expected = F.greatest(line, F.lit(0.0)) if floor_at_zero else line
    worst = expected - band
    worst = F.greatest(worst, F.lit(0.0)) if floor_at_zero else worst
    label = F.concat(F.lit("Period +"), F.col("step").cast("string"))
    if is_time(series.schema[order].dataType):
        label = F.coalesce(future_label(F.col("last_at"), F.col("gap_days"), F.col("step")), label)
    return ahead.select(
        *[ref(b) for b in by], "step", label.alias("period"),
        F.round(expected, 2).alias("expected"), F.round(expected + band, 2).alias("best_case"),
        F.round(worst, 2).alias("worst_case"))


def forecast_summary(
    series: DataFrame, value: str = "value", order: str = "period_start",
    by: list[str] | None = None, horizon: int = HORIZON, metric_name: str = "Metric",
) -> DataFrame:
    """Mean, growth per period in percent, and its direction in words, per series."""
    by = list(by or [])
    fit = fit_trend(series, value, order, by)
    mean = F.when(F.col("mean") == 0, F.lit(1.0)).otherwise(F.col("mean"))
    growth = F.round(F.col("slope") / mean * 100, 2) + 0.0
    facts = fit.select(*[ref(b) for b in by], F.round(mean, 2).alias("historical_mean"),
                       growth.alias("growth_pct"))
    direction = (F.when(F.col("growth_pct") > RISING_ABOVE, "Bullish Growth")
                 .when(F.col("growth_pct") < FALLING_BELOW, "Declining").otherwise("Stable"))
    sign = F.when(F.col("growth_pct") >= 0, F.lit("+")).otherwise(F.lit(""))
    shown = F.concat(sign, plain_number(F.col("growth_pct"), 1), F.lit("%"))
    return facts.withColumns({"direction": direction, "projected_growth": shown}).withColumn(
        "summary", F.concat(
            F.lit(f"{metric_name} demonstrates a "), F.lower("direction"),
            F.lit(" trajectory projected at "), F.col("projected_growth"),
            F.lit(f" change across the next {horizon} periods.")))


def forecast_table(
    df: DataFrame, date: str, metric: str, func: str = "sum", by: list[str] | None = None,
    horizon: int = HORIZON, last: int = LAST_PERIODS,
) -> DataFrame:
    """Forecast a table: its last periods at the automatic grain, then the trend."""
    by = list(by or [])
    return forecast(recent_periods(df, date, metric, func, by, last), by=by, horizon=horizon)


def recent_periods(
    df: DataFrame, date: str, metric: str, func: str = "sum", by: list[str] | None = None,
    last: int = LAST_PERIODS,
) -> DataFrame:
    """The last periods of each group: (by, period_start, grain, value)."""
    by = list(by or [])
    found = period_values(df, date, metric, func, by)
    if not by:
        return found.orderBy(F.desc("period_start")).limit(last)
    newest = Window.partitionBy(*[ref(b) for b in by]).orderBy(F.desc("period_start"))
    ranked = found.withColumn("_rank", F.row_number().over(newest))
    return ranked.filter(F.col("_rank") <= last).drop("_rank")
