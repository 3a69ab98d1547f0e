import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tallyloom.functions.display import display_number
from tallyloom.operators.aggregate import aggregate
from tallyloom.operators.crosstab import heatmap_series, pivoted_series, stacked_series
from tallyloom.operators.distribution import box_stats, histogram, scatter_pairs
from tallyloom.operators.series import (
    category_series, clamp_limit, leading_item, period_change, period_series, radar_items, top_n,
)


@pytest.mark.parametrize("value, options, text", [
    (None, {}, "—"), (0.0, {}, "0.00"), (0.004, {}, "0.0040"), (0.125, {}, "0.12"),
    (2.675, {}, "2.67"), (5.0, {}, "5"), (99.5, {}, "99.50"), (1234.0, {}, "1,234"),
    (2500.5, {}, "2,500"), (10000.0, {}, "10.0K"), (-25000.0, {}, "-25.0K"),
    (1234567.0, {}, "1.23M"), (7.5e9, {}, "7.50B"), (1.5e12, {}, "1500.00B"),
    (12.5, {"format_type": "currency"}, "$12.50"), (12.5, {"unit": "€"}, "€12.50"),
    (12345.0, {"unit": "%"}, "12,345%"), (3.0, {"unit": "kg"}, "3 kg"), (3.0, {"unit": "g"}, "3g"),
])
def test_display(spark, value, options, text):
    shown = spark.range(1).select(display_number(F.lit(value).cast("double"), **options))
    assert shown.first()[0] == text


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None), (None, 7.0)], "k string, v double")


@pytest.mark.parametrize("func, values", [
    ("sum", {"a": 4.0, "b": 5.0, "c": 0.0, None: 7.0}),
    ("anything", {"a": 4.0, "b": 5.0, "c": 0.0, None: 7.0}),
    ("Average", {"a": 2.0, "b": 5.0, "c": None, None: 7.0}),
    ("med", {"a": 2.0, "b": 5.0, "c": None, None: 7.0}),
    ("volume", {"a": 2, "b": 1, "c": 0, None: 1}),
    ("unique", {"a": 2, "b": 1, "c": 0, None: 1}),
    ("minimum", {"a": 1.0, "b": 5.0, "c": None, None: 7.0}),
    ("max", {"a": 3.0, "b": 5.0, "c": None, None: 7.0}),
    ("stddev", {"a": pytest.approx(2 ** 0.5), "b": 0.0, "c": 0.0, None: 0.0}),
])
def test_aggregations(sales, func, values):
    found = aggregate(sales, "v", func, ["k"])
    assert {r["k"]: r["value"] for r in found.collect()} == values


def test_category_series(sales):
    rows = category_series(sales, "k", "v").collect()
    assert [(r["position"], r["name"], r["value"], r["percentage"]) for r in rows] == [
        (1, "b", 5.0, 55.6), (2, "a", 4.0, 44.4)]
    assert [r["name"] for r in top_n(sales, "k", "v", 1, "bottom").collect()] == ["a"]
    assert [r["scaled"] for r in radar_items(sales, "k", "v").collect()] == [100.0, 80.0]
    best = leading_item(category_series(sales, "k", "v")).first()
    assert (best["name"], best["percentage"], best["total"], best["items"]) == ("b", 55.6, 9.0, 2)
    assert [clamp_limit(x) for x in (None, 0, 7, 99)] == [12, 1, 7, 50]


def test_period_grains(daily):
    assert [r["name"] for r in period_series(daily, "day", "sales").collect()][:2] == [
        "2023-01", "2023-02"]   # 730 days are not over 730
    longer = daily.union(daily.selectExpr("day + INTERVAL 1 DAY", "sales"))
    rows = period_series(longer, "day", "sales").collect()
    assert rows[0]["name"] == "2023Q1" and rows[-1]["name"] == "2025Q1"
    short = daily.filter("day < '2023-01-15'")
    assert [r["name"] for r in period_series(short, "day", "sales").collect()] == [
        "2022-12-26/2023-01-01", "2023-01-02/2023-01-08", "2023-01-09/2023-01-15"]
    assert period_series(daily, "day", "sales", last=5).collect()[-1]["name"] == "2024-12"
    kinds = dict(period_series(daily, "day", "sales").dtypes)
    assert kinds["period_start"] == "timestamp_ntz"


def test_period_change_does_not_skip_missing_months(spark):
    df = spark.createDataFrame(
        [("2024-01-05", 10.0), ("2024-02-05", 15.0), ("2024-04-05", 30.0)], "d string, v double")
    rows = {str(r["period_start"])[:7]: r["change_pct"] for r in
            period_change(df, "d", "v", 1).collect()}
    assert rows == {"2024-01": None, "2024-02": 50.0, "2024-04": None}


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).normal(size=500), np.random.default_rng(2).integers(0, 40, 300),
    np.array([3.0, 3.0, 3.0]), np.arange(10.0), np.array([1.0, 2.0]), np.linspace(0, 1, 61),
])
def test_histogram_matches_numpy(spark, values):
    values = values.astype(float)
    bins = 6 if len(values) >= 50 else min(5, max(3, len(set(values))))
    counts, edges = np.histogram(values, bins=bins)
    rows = histogram(spark.createDataFrame([(float(v),) for v in values], "v double"), "v")
    rows = rows.orderBy("position").collect()
    assert [r["value"] for r in rows] == counts.tolist()
    assert np.allclose([r["range_min"] for r in rows] + [rows[-1]["range_max"]], edges)


def test_histogram_of_nothing(spark):
    assert histogram(spark.createDataFrame([(None,)], "v double"), "v").count() == 0


def test_box_stats(spark):
    df = spark.createDataFrame(
        [("a", float(v)) for v in range(1, 6)] + [("b", 9.0)], "k string, v double")
    rows = box_stats(df, "v", "k").collect()
    assert [tuple(r)[:6] for r in rows] == [("a", 1.0, 2.0, 3.0, 4.0, 5.0)]
    single = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    assert [tuple(r)[:2] for r in box_stats(single, "v", "k").collect()] == [("v", 1.0)]


def test_crosstabs(spark):
    df = spark.createDataFrame(
        [("x", "p", 1.0), ("x", "q", 2.0), ("y", "p", 4.0), ("y", "p", 6.0)],
        "a string, b string, v double")
    cells = {(r["name"], r["segment"]): (r["value"], r["row_total"])
             for r in stacked_series(df, "a", "b", "v").collect()}
    assert cells == {("x", "p"): (1.0, 3.0), ("x", "q"): (2.0, 3.0),
                     ("y", "p"): (10.0, 10.0), ("y", "q"): (0.0, 10.0)}
    heat = {(r["x"], r["y"]): (r["value"], r["intensity"])
            for r in heatmap_series(df, "a", "b", "v", "mean").collect()}
    assert heat == {("x", "p"): (1.0, 0.2), ("x", "q"): (2.0, 0.4),
                    ("y", "p"): (5.0, 1.0), ("y", "q"): (0.0, 0.0)}
    wide = {r["name"]: (r["p"], r["q"]) for r in pivoted_series(df, "a", "b", "v").collect()}
    assert wide == {"x": (1.0, 2.0), "y": (10.0, 0.0)}


def test_crosstab_reads_the_table_once(tables):
    df = stacked_series(tables.part, "p_name", "p_brand", "p_retailprice")
    df.collect()
    plan = plan_of(df).split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 2


def test_scatter_sample_repeats(tables):
    runs = [scatter_pairs(tables.orders, "o_custkey", "o_totalprice", ["o_orderkey"], 50).collect()
            for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 50
