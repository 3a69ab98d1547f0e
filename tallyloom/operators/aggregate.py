"""Group and whole-table aggregates chosen by name."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import ref, require
from tallyloom.functions.fixed import AVERAGED_WORDS
from tallyloom.operators.ordered import percentiles

# --- fixed values: names of aggregations --------------------------------------------------
AGGREGATION_NAMES = {
    "mean": ["mean", "avg", "average"],
    "median": ["median", "med"],
    "count": ["count", "cnt", "volume"],
    "count_distinct": ["count_distinct", "unique", "distinct"],
    "min": ["min", "minimum"],
    "max": ["max", "maximum"],
    "std": ["std", "stddev"],
}


def default_aggregation(metric: str) -> str:
    """Rates, scores and the like are averaged, everything else is summed."""
    return "mean" if any(word in metric.lower() for word in AVERAGED_WORDS) else "sum"


def aggregation_name(func: str | None, metric: str = "") -> str:
    """The aggregation a name stands for; ``auto`` goes by the metric, unknown names are sums."""
    name = (func or "sum").lower().strip()
    if name == "auto":
        return default_aggregation(metric)
    return next((k for k, names in AGGREGATION_NAMES.items() if name in names), "sum")


def measure(func: str, metric: Column) -> Column:
    """The aggregate expression for every aggregation but the median."""
    return {
        "sum": lambda: F.coalesce(F.sum(metric), F.lit(0)),
        "mean": lambda: F.avg(metric),
        "count": lambda: F.count(metric),
        "count_distinct": lambda: F.countDistinct(metric),
        "min": lambda: F.min(metric),
        "max": lambda: F.max(metric),
        "std": lambda: F.coalesce(F.stddev_samp(metric), F.lit(0.0)),
    }[func]()


def aggregate(
    df: DataFrame,
    metric: str,
    func: str | None = "sum",
    by: list[str] | None = None,
    name: str = "value",
    approx: bool = False) -> DataFrame:
    """One row per group, missing groups included, or one row in all. A sum over nothing but
    gaps is 0, the other aggregations are NULL there, a deviation of one row is 0."""
    by = list(by or [])
    require(df, metric, *by)
    func = aggregation_name(func, metric)
    groups = df.groupBy(*[ref(b) for b in by])
    if func == "median" and not approx:
        found = percentiles(df, metric, [0.5], by)
        return found.select(*[ref(b) for b in by], F.get("quantiles", F.lit(0)).alias(name))
    if func == "median":
        return groups.agg(F.percentile_approx(ref(metric).cast("double"), 0.5).alias(name))
    if func == "count_distinct" and approx:
        return groups.agg(F.approx_count_distinct(ref(metric)).alias(name))
    return groups.agg(measure(func, ref(metric)).alias(name))
