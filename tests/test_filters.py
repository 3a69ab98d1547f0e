import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tallyloom.operators.filters import (
    filter_report, filter_rows, keep_top_values, time_filter, top_values, value_filters,
)


@pytest.mark.parametrize("kind, options, rows", [
    ("this_year", {}, 366), ("ytd", {}, 366), ("last_year", {}, 365),
    ("year", {"year": 2023}, 365), ("last_quarter", {}, 92), ("this_quarter", {}, 92),
    ("last_n", {"n": 1, "unit": "month"}, 32),      # back to 30 November
    ("last_n", {"n": 2, "unit": "quarter"}, 185),   # back to 30 June
    ("last_n", {"n": 1, "unit": "year"}, 367),
    ("last_n", {"n": 2, "unit": "week"}, 15),
    ("last_n", {"n": 3, "unit": "day"}, 4),
])
def test_time_ranges(daily, kind, options, rows):
    assert time_filter(daily, "day", kind, **options).count() == rows
    as_date = daily.withColumn("day", F.col("day").cast("date"))
    assert time_filter(as_date, "day", kind, **options).count() == rows
    as_text = daily.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    assert time_filter(as_text, "day", kind, **options).count() == rows


def test_first_quarter_reaches_back_a_year(daily):
    early = daily.filter("day < '2024-03-01'")
    found = time_filter(early, "day", "last_quarter").agg(F.min("day"), F.max("day")).first()
    assert [str(x)[:10] for x in found] == ["2023-10-01", "2023-12-31"]


def test_time_filter_that_leaves_nothing(daily):
    assert time_filter(daily, "day", "year", year=1990).count() == 0
    assert time_filter(daily, "day", "year", year=1990, on_empty="ignore").count() == 731
    with pytest.raises(ValueError):
        time_filter(daily, "day", "yoy")
    with pytest.raises(ValueError):
        time_filter(daily, "sales", "ytd")
    no_dates = daily.selectExpr("'soon' AS day", "sales")
    assert time_filter(no_dates, "day", "last_year").count() == 731


def test_bounds_reach_the_scan(tables):
    plan = plan_of(time_filter(tables.orders, "o_orderdate", "last_quarter"))
    assert "GreaterThanOrEqual(o_orderdate,2001-" in plan
    assert "LessThan(o_orderdate,2001-" in plan
    plan = plan_of(time_filter(tables.orders, "o_orderdate", "year", year=1998))
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01" in plan


@pytest.fixture(scope="module")
def regions(spark):
    return spark.createDataFrame(
        [("North", 10), ("SOUTH", 20), ("east", 30), (None, 40), ("north", None)],
        "region string, sales int")


def test_value_filters(regions):
    def left(*filters, **options):
        items = [dict(zip(("column", "operator", "value"), f)) for f in filters]
        return sorted(r["sales"] or 0 for r in value_filters(regions, items, **options).collect())

    assert left(("region", "==", "NORTH")) == [0, 10]
    assert left(("region", "!=", "north")) == [20, 30, 40]
    assert left(("sales", ">=", "20"), ("sales", "<", 40)) == [20, 30]
    assert left(("sales", ">", "many")) == [0, 10, 20, 30, 40]
    assert left(("nowhere", "==", 1)) == [0, 10, 20, 30, 40]
    assert left(("region", "==", "x")) == []
    assert left(("region", "==", "x"), ("sales", ">", 15), on_empty="ignore") == [20, 30, 40]
    with pytest.raises(ValueError):
        left(("sales", ">", "many"), on_bad="raise")


def test_filter_rows(regions):
    assert filter_rows(regions, "sales", "!=", 10).count() == 4
    assert filter_rows(regions, "sales", "==", 10).count() == 1
    assert tuple(filter_report(regions, "sales", ">", 15).first()) == (5, 3, 2)
    with pytest.raises(ValueError):
        filter_rows(regions, "sales", "~", 1)
    with pytest.raises(ValueError):
        filter_rows(regions, "missing", "==", 1)


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(x,) for x in "bbaaccd"], "k string")
    assert [r["k"] for r in top_values(df, "k", 2).collect()] == ["a", "b"]
    assert keep_top_values(df, "k", 2).count() == 4
