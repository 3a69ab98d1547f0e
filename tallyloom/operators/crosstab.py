"""Two dimensions crossed: stacked series and heatmaps.

All cells are aggregated once. The most frequent values of each dimension are then found from
the cells, not from the rows again; the three readers share one exchange."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.columns import clean_number, ref, require
from tallyloom.functions.display import display_number
from tallyloom.operators.aggregate import aggregation_name, measure
from tallyloom.operators.ordered import percentiles

# --- fixed values: sizes ------------------------------------------------------------------
STACKED_FIRST, STACKED_SECOND = 8, 5
HEATMAP_FIRST, HEATMAP_SECOND = 6, 5


def _cells(df: DataFrame, first: str, second: str, metric: str, func: str) -> DataFrame:
    require(df, first, second, metric)
    rows = df.select(ref(first).alias("dim1"), ref(second).alias("dim2"),
                     ref(metric).alias("metric")).na.drop()
    rows = rows.filter(F.col("dim1").isNotNull() & F.col("dim2").isNotNull())
    if func == "median":
        found = percentiles(rows, "metric", [0.5], ["dim1", "dim2"])
        return found.select("dim1", "dim2", "n", F.get("quantiles", F.lit(0)).alias("value"))
    value = F.sum("metric") if func == "sum" else measure(func, F.col("metric"))
    cells = rows.groupBy("dim1", "dim2").agg(F.count("metric").alias("n"), value.alias("value"))
    # every cell has rows; naming the value here, and the dimensions above as the joins will do,
    # keeps all readers on the same exchange
    return cells.filter((F.col("n") > 0) & F.col("value").isNotNull())


def _most_frequent(cells: DataFrame, dimension: str, k: int) -> DataFrame:
    counts = cells.groupBy(dimension).agg(F.sum("n").alias("rows"))
    return counts.orderBy(F.desc("rows"), dimension).limit(k).select(dimension)


def _top_cells(df: DataFrame, first: str, second: str, metric: str, func: str,
               k1: int, k2: int) -> DataFrame:
    cells = _cells(df, first, second, metric, aggregation_name(func, metric))
    top1, top2 = _most_frequent(cells, "dim1", k1), _most_frequent(cells, "dim2", k2)
    kept = cells.join(F.broadcast(top1), "dim1", "left_semi")
    return kept.join(F.broadcast(top2), "dim2", "left_semi")


def _grid(kept: DataFrame) -> DataFrame:
    """The kept cells with the combinations that have no rows as value 0. There are at most
    8 x 5 cells, so both lists of values fit in one row."""
    lists = kept.agg(F.collect_set("dim1").alias("d1"), F.collect_set("dim2").alias("d2"),
                     F.collect_list(F.struct("dim1", "dim2", "value")).alias("cells"))
    combined = lists.select("cells", "d2", F.explode("d1").alias("dim1")).select(
        "cells", "dim1", F.explode("d2").alias("dim2")
    )
    match = F.filter("cells", lambda c: (c["dim1"] == F.col("dim1")) & (c["dim2"] == F.col("dim2")))
    return combined.select("dim1", "dim2", clean_number(F.get(match, F.lit(0))["value"]).alias("value"))


def stacked_series(df: DataFrame, first: str, second: str, metric: str,
                   func: str = "sum") -> DataFrame:
    """(name, segment, value, row_total) for the 8 x 5 most frequent values; empty cells are 0."""
    grid = _grid(_top_cells(df, first, second, metric, func, STACKED_FIRST, STACKED_SECOND))
    return grid.select(
        F.col("dim1").cast("string").alias("name"), F.col("dim2").cast("string").alias("segment"),
        "value",
        F.round(F.sum("value").over(Window.partitionBy("dim1")), 4).alias("row_total"),
    )


def pivoted_series(df: DataFrame, first: str, second: str, metric: str,
                   func: str = "sum") -> DataFrame:
    """The stacked series with one column per segment. The segments are read from the result, at
    most five."""
    long = stacked_series(df, first, second, metric, func)
    segments = [r.segment for r in long.select("segment").distinct().orderBy("segment").collect()]
    wide = long.groupBy("name", "row_total").pivot("segment", segments).agg(F.first("value"))
    return wide.na.fill(0.0)


def heatmap_series(df: DataFrame, first: str, second: str, metric: str,
                   func: str = "sum") -> DataFrame:
    """(x, y, value, intensity, formatted_value) for the 6 x 5 most frequent values."""
    grid = _grid(_top_cells(df, first, second, metric, func, HEATMAP_FIRST, HEATMAP_SECOND))
    largest = F.max("value").over(Window.partitionBy())
    intensity = F.col("value") / F.when(largest == 0, F.lit(1.0)).otherwise(largest)
    return grid.select(
        F.col("dim1").cast("string").alias("x"), F.col("dim2").cast("string").alias("y"), "value",
        F.round(intensity, 2).alias("intensity"),
        display_number(F.col("value")).alias("formatted_value"),
    )
