"""Comparisons, value filters and time ranges."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.registry import query
from tallyloom.operators.filters import (
    complete_rows, filter_report, filter_rows, parse_date_column, parse_number_column, time_filter,
    value_filters,
)

_LATEST = "(SELECT max(o_orderdate) FROM orders)"


def _orders(df):
    return df.select("o_orderkey", "o_orderstatus", "o_totalprice",
                     F.col("o_orderdate").cast("date").cast("string").alias("day"))


def _orders_sql(condition: str) -> str:
    return ("SELECT o_orderkey, o_orderstatus, o_totalprice, "
            f"CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE {condition}")


def _events(df):
    return df.select("event_id", "event_type", "value")


def _events_sql(condition: str) -> str:
    return f"SELECT event_id, event_type, value FROM events WHERE {condition}"


@query("F1", _orders_sql("o_totalprice > 250000"))
def rows_above_price(t):
    return _orders(filter_rows(t.orders, "o_totalprice", ">", 250000))


@query("F1", "SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_tax, 0) AS l_tax FROM lineitem "
             "WHERE nullif(l_tax, 0) IS DISTINCT FROM 0.08")
def rows_not_equal_keep_gaps(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    return filter_rows(rows, "l_tax", "!=", 0.08)


@query("F1", """
    SELECT count(*) AS rows_before, count(*) FILTER (l_quantity <= 10) AS rows_after,
           count(*) FILTER (NOT l_quantity <= 10) AS removed FROM lineitem""")
def filter_removed_count(t):
    return filter_report(t.lineitem, "l_quantity", "<=", 10)


@query("F2", _orders_sql("lower(o_orderpriority) = '1-urgent'"))
def value_equals_any_case(t):
    return _orders(value_filters(t.orders, [
        {"column": "o_orderpriority", "operator": "==", "value": "1-Urgent"}]))


@query("F2 F3 F4", _orders_sql("o_orderstatus <> 'F' AND o_totalprice >= 100000 "
                               "AND o_totalprice < 400000"))
def value_filters_together(t):
    return _orders(value_filters(t.orders, [
        {"column": "o_orderstatus", "operator": "!=", "value": "f"},
        {"column": "o_totalprice", "operator": ">=", "value": "100000"},
        {"column": "o_totalprice", "operator": "<", "value": 400000},
        {"column": "o_totalprice", "operator": ">", "value": "many"},
        {"column": "no_such_column", "operator": "==", "value": 1},
    ]))


@query("F5", _orders_sql("o_orderstatus = 'O'"))
def empty_filter_ignored(t):
    return _orders(value_filters(t.orders, [
        {"column": "o_orderstatus", "operator": "==", "value": "O"},
        {"column": "o_totalprice", "operator": "<", "value": -1},
    ], on_empty="ignore"))


@query("F6 F7", _orders_sql(f"year(o_orderdate) = year({_LATEST})"))
def time_this_year(t):
    return _orders(time_filter(t.orders, "o_orderdate", "ytd"))


@query("F6 F8", _orders_sql(f"year(o_orderdate) = year({_LATEST}) - 1"))
def time_last_year(t):
    return _orders(time_filter(t.orders, "o_orderdate", "last_year"))


@query("F9", _orders_sql("year(o_orderdate) = 1998"))
def time_one_year(t):
    return _orders(time_filter(t.orders, "o_orderdate", "year", year=1998))


@query("F10", _orders_sql(f"o_orderdate >= {_LATEST} - INTERVAL 6 MONTH"))
def time_last_months(t):
    return _orders(time_filter(t.orders, "o_orderdate", "last_n", 6, "month"))


@query("F10", _orders_sql(f"o_orderdate >= {_LATEST} - INTERVAL 6 MONTH"))
def time_last_quarters(t):
    return _orders(time_filter(t.orders, "o_orderdate", "last_n", 2, "quarter"))


@query("F10", _orders_sql(f"o_orderdate >= {_LATEST} - INTERVAL 2 YEAR"))
def time_last_years(t):
    return _orders(time_filter(t.orders, "o_orderdate", "last_n", 2, "year"))


@query("F10", _events_sql("ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY"))
def time_last_weeks(t):
    return _events(time_filter(t.events, "ts", "last_n", 2, "week"))


@query("F10", _events_sql("ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY"))
def time_last_days(t):
    return _events(time_filter(t.events, "ts", "last_n", 3, "day"))


@query("F11", _orders_sql(
    f"o_orderdate >= date_trunc('quarter', {_LATEST}) - INTERVAL 3 MONTH "
    f"AND o_orderdate < date_trunc('quarter', {_LATEST})"))
def time_last_quarter(t):
    return _orders(time_filter(t.orders, "o_orderdate", "last_quarter"))


@query("F12", _orders_sql(f"o_orderdate >= date_trunc('quarter', {_LATEST})"))
def time_this_quarter(t):
    return _orders(time_filter(t.orders, "o_orderdate", "this_quarter"))


@query("F14", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
    WHERE o_orderstatus <> 'P'""")
def date_text_parsed(t):
    texts = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "soon").otherwise(
        F.date_format("o_orderdate", "d MMM yyyy")).alias("day"))
    return parse_date_column(texts, "day").select("o_orderkey", F.col("day").cast("date").cast("string").alias("day"))


@query("F15", "SELECT l_discount, l_tax FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0")
def rows_without_gaps(t):
    gaps = t.lineitem.select(F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
                             F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    return complete_rows(gaps, ["l_discount", "l_tax"])


@query("F16", """
    SELECT p_partkey, CAST(regexp_extract(p_brand, '\\d+') AS DOUBLE) AS code FROM part
    WHERE p_type <> 'ECONOMY'""")
def number_text_parsed(t):
    texts = t.part.select("p_partkey", F.when(F.col("p_type") == "ECONOMY", F.col("p_brand"))
                          .otherwise(F.regexp_extract("p_brand", r"\d+", 0)).alias("code"))
    return parse_number_column(texts, "code")


@query("F13", "SELECT o_orderkey, o_orderpriority FROM orders")
def time_without_dates(t):
    """A column without any date filters nothing."""
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    return time_filter(rows, "o_orderpriority", "last_year")
