"""Histograms, five-number summaries and scatter samples."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.columns import as_number, clean_number, ref, require
from tallyloom.functions.display import display_number, whole_number
from tallyloom.operators.filters import top_values
from tallyloom.operators.ordered import percentiles
from tallyloom.sources.preview import sample_rows

# --- fixed values: sizes ------------------------------------------------------------------
BINS, FEWEST_BINS, MOST_BINS_WHEN_FEW, FEW_ROWS = 6, 3, 5, 50
BOX_GROUPS, BOX_LEAST_ROWS = 5, 2
SCATTER_ROWS, SCATTER_SIZE = 300, 100


def histogram(df: DataFrame, metric: str, format_type: str | None = None,
              unit: str | None = None) -> DataFrame:
    """Counts in equal bins, empty bins shown: (position, name, value, range_min, range_max,
    formatted_value). Two passes: the range, then one count per bin - no grouping, no join."""
    require(df, metric)
    values = df.select(as_number(df, metric).alias("v")).filter(F.col("v").isNotNull())
    # with fewer than 50 rows the first 50 are all of them
    distinct = values.limit(FEW_ROWS).agg(F.countDistinct("v").alias("d")).scalar()
    few = F.least(F.lit(MOST_BINS_WHEN_FEW), F.greatest(F.lit(FEWEST_BINS), distinct))
    low, high = F.min("v"), F.max("v")
    range_ = values.agg(
        F.struct(
            F.when(low == high, low - 0.5).otherwise(low).alias("low"),
            F.when(low == high, high + 0.5).otherwise(high).alias("high"),
            F.when(F.count("v") >= FEW_ROWS, BINS).otherwise(few).cast("int").alias("bins"),
            F.min(F.col("v") == F.floor("v")).alias("whole"),
        ).alias("r")
    ).scalar()
    range_column = range_.alias("r")
    size = F.col("r.bins")
    step = (F.col("r.high") - F.col("r.low")) / size

    def edge(i):
        return F.when(F.lit(i) == size, F.col("r.high")).otherwise(i * step + F.col("r.low"))

    at_least = [F.count_if(F.col("v") >= edge(F.lit(i))) for i in range(1, BINS)]
    totals = values.select("v", range_column).agg(
        F.count("v").alias("n"), F.array(*at_least).alias("above"))
    bins = totals.filter(F.col("n") > 0).select(
        F.concat(F.array("n"), "above").alias("starts"), range_column
    ).withColumn("position", F.explode(F.sequence(F.lit(1), size)))
    place = F.col("position")
    ends = F.when(place == size, F.lit(0)).otherwise(F.get("starts", place))
    counted = bins.select(
        "position", (F.get("starts", place - 1) - ends).alias("value"), "r",
        edge(place - 1).alias("range_min"), edge(place).alias("range_max"))

    def label(bound):
        return F.when(F.col("r.whole"), whole_number(F.col(bound))).otherwise(
            display_number(clean_number(F.col(bound)), format_type, unit)
        )

    return counted.select(
        "position", F.concat(label("range_min"), F.lit(" - "), label("range_max")).alias("name"),
        "value", "range_min", "range_max",
        F.concat(F.format_number("value", 0), F.lit(" records")).alias("formatted_value"),
    )


def _summary(found: DataFrame, name) -> DataFrame:
    quantile = [clean_number(F.get("quantiles", F.lit(i))) for i in range(3)]
    return found.filter(F.col("n") >= BOX_LEAST_ROWS).select(
        name.alias("name"), clean_number(F.col("lowest")).alias("min"), quantile[0].alias("q1"),
        quantile[1].alias("median"), quantile[2].alias("q3"),
        clean_number(F.col("highest")).alias("max"),
        F.concat(F.lit("Median: "), display_number(F.get("quantiles", F.lit(1))))
        .alias("formatted_value"),
    )


def box_stats(df: DataFrame, metric: str, dimension: str | None = None) -> DataFrame:
    """Five-number summaries of the five groups with most values; the whole column when there is
    no group with two values."""
    require(df, metric, *([dimension] if dimension else []))
    shares = [0.25, 0.5, 0.75]
    values = df.filter(ref(metric).isNotNull())
    if dimension:
        pairs = values.select(ref(dimension).alias("name"), ref(metric).alias("metric"))
        # at most five values reach the driver, and go back to the scan as a filter
        top = top_values(pairs, "name", BOX_GROUPS).filter(F.col("n") >= BOX_LEAST_ROWS).collect()
        if top:
            kept = pairs.filter(F.col("name").isin([r["name"] for r in top]))
            found = percentiles(kept, "metric", shares, ["name"])
            return _summary(found, F.col("name").cast("string"))
    return _summary(percentiles(values, metric, shares, None), F.lit(metric))


def scatter_pairs(df: DataFrame, x: str, y: str, key: list[str], n: int = SCATTER_ROWS,
                  format_type: str | None = None) -> DataFrame:
    """A sample of complete pairs, the same on each run: (position, name, x, y, z, x_label,
    y_label, formatted_x, formatted_y)."""
    require(df, x, y, *key)
    pairs = df.select(as_number(df, x).alias("x"), as_number(df, y).alias("y"),
                      *[ref(k).alias(f"_k{i}") for i, k in enumerate(key)])
    keys = [f"_k{i}" for i in range(len(key))]
    chosen = sample_rows(pairs.na.drop(subset=["x", "y"]), n, keys)
    return _decorated(chosen, keys, x, y, format_type)


def first_pairs(df: DataFrame, x: str, y: str, order_by: list[str],
                n: int = SCATTER_ROWS, format_type: str | None = None) -> DataFrame:
    """The first complete pairs in the order of ``order_by``, with the same columns."""
    require(df, x, y, *order_by)
    keys = [f"_k{i}" for i in range(len(order_by))]
    pairs = df.select(as_number(df, x).alias("x"), as_number(df, y).alias("y"),
                      *[ref(k).alias(f"_k{i}") for i, k in enumerate(order_by)])
    chosen = pairs.na.drop(subset=["x", "y"]).orderBy(*keys).limit(n)
    return _decorated(chosen, keys, x, y, format_type)


def _decorated(pairs: DataFrame, keys: list[str], x: str, y: str,
               format_type: str | None) -> DataFrame:
    place = F.row_number().over(Window.orderBy(*keys)).cast("int")
    numbered = pairs.select(place.alias("position"), clean_number(F.col("x")).alias("x"),
                            clean_number(F.col("y")).alias("y"))
    return numbered.select(
        "position", F.concat(F.lit("Record "), F.col("position").cast("string")).alias("name"),
        "x", "y", F.lit(SCATTER_SIZE).alias("z"), F.lit(x).alias("x_label"),
        F.lit(y).alias("y_label"), display_number(F.col("x"), format_type).alias("formatted_x"),
        display_number(F.col("y"), format_type).alias("formatted_y"),
    )
