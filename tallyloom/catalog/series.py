"""Rankings, shares, trends and period changes."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.registry import query, rounded, sql_display, sql_ranked, sql_share
from tallyloom.functions.dates import period_label
from tallyloom.operators.crosstab import heatmap_series, pivoted_series, stacked_series
from tallyloom.operators.filters import time_filter
from tallyloom.operators.series import (
    category_series, compare_metrics, funnel_stages, latest_entries, leading_item, leading_rows,
    month_totals, period_change, period_series, radar_items, top_n, treemap_items,
)

_BY_NAME = "SELECT p_name AS name, sum(p_retailprice) AS value FROM part GROUP BY 1"
_BY_PRIORITY = ("SELECT o_orderpriority AS name, sum(o_totalprice) AS value FROM orders "
                "GROUP BY 1")


@query("A9 W1 T1 T2 F15 P7", sql_ranked(_BY_NAME, 12))
def ranked_categories(t):
    return rounded(category_series(t.part, "p_name", "p_retailprice"), "value")


@query("A9", sql_ranked(
    "SELECT p_brand AS name, median(p_retailprice) AS value FROM part GROUP BY 1", 12))
def ranked_by_median(t):
    return rounded(category_series(t.part, "p_brand", "p_retailprice", "median"), "value")


@query("A9 P8", sql_ranked(_BY_PRIORITY, 50, display=sql_display("value", before="€")))
def ranked_with_currency(t):
    shown = category_series(t.orders, "o_orderpriority", "o_totalprice", limit=99, unit="€")
    return rounded(shown, "value")


@query("T4", sql_ranked(_BY_NAME, 5, ascending=True))
def bottom_names(t):
    return rounded(top_n(t.part, "p_name", "p_retailprice", 5, "bottom"), "value")


@query("T4", sql_ranked(
    "SELECT o_custkey AS name, sum(o_totalprice) AS value FROM orders GROUP BY 1", 10))
def top_customers(t):
    return rounded(top_n(t.orders, "o_custkey", "o_totalprice", 10), "value")


@query("A18", f"""SELECT position, name, value AS size, value, percentage
                  FROM ({sql_ranked(_BY_NAME, 10)})""")
def treemap_of_names(t):
    return rounded(treemap_items(t.part, "p_name", "p_retailprice"), "size", "value")


@query("A19", f"""SELECT position, name AS subject, round(value / max(value) OVER () * 100, 1) AS scaled,
                         value, CAST(100 AS INTEGER) AS full_mark FROM ({sql_ranked(_BY_NAME, 6)})""")
def radar_of_names(t):
    return rounded(radar_items(t.part, "p_name", "p_retailprice"), "value")


@query("A20", sql_ranked(_BY_PRIORITY, 6))
def funnel_of_priorities(t):
    return rounded(funnel_stages(t.orders, "o_orderpriority", "o_totalprice"), "value")


@query("A21", sql_ranked(
    "SELECT event_type AS name, CAST(count(value) AS DOUBLE) AS value FROM events GROUP BY 1", 12))
def share_of_events(t):
    return rounded(category_series(t.events, "event_type", "value", "count"), "value")


@query("A25", sql_ranked(_BY_NAME, 8))
def category_extract(t):
    return rounded(category_series(t.part, "p_name", "p_retailprice", "sum", 8), "value")


_QUARTERS = """
    WITH g AS (SELECT date_trunc('quarter', o_orderdate) AS p, sum(o_totalprice) AS v
               FROM orders GROUP BY 1),
    newest AS (SELECT * FROM g ORDER BY p DESC LIMIT 36),
    shown AS (SELECT CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS position,
                     year(p) || 'Q' || quarter(p) AS name, round(v, 4) AS value FROM newest)"""
_TREND = (f"SELECT position, name, round(value, 2) AS value, {sql_share()} AS percentage, "
          f"{sql_display('value')} AS formatted_value FROM shown")


@query("A11 W2", f"{_QUARTERS} {_TREND}")
def trend_by_quarter(t):
    shown = period_series(t.orders, "o_orderdate", "o_totalprice")
    return rounded(shown.drop("period_start"), "value")


@query("A11 F10", f"""
    WITH g AS (SELECT date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS v FROM orders
               WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 12 MONTH
               GROUP BY 1),
    shown AS (SELECT CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS position,
                     strftime(p, '%Y-%m') AS name, round(v, 4) AS value FROM g) {_TREND}""")
def trend_by_month(t):
    recent = time_filter(t.orders, "o_orderdate", "last_n", 12, "month")
    shown = period_series(recent, "o_orderdate", "o_totalprice")
    return rounded(shown.drop("period_start"), "value")


_WEEK = """strftime(p, '%Y-%m-%d') || '/' || strftime(p + INTERVAL 6 DAY, '%Y-%m-%d')"""


@query("A11", f"""
    WITH g AS (SELECT date_trunc('week', ts) AS p, avg(value) AS v FROM events GROUP BY 1),
    shown AS (SELECT CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS position,
                     {_WEEK} AS name, round(v, 4) AS value FROM g) {_TREND}""")
def trend_by_week(t):
    shown = period_series(t.events, "ts", "value", "mean")
    return rounded(shown.drop("period_start"), "value")


@query("A11 F14", f"""
    WITH texts AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'n/a'
                               ELSE strftime(o_orderdate, '%Y/%m/%d') END AS d, o_totalprice FROM orders),
    g AS (SELECT date_trunc('quarter', CAST(replace(d, '/', '-') AS TIMESTAMP)) AS p,
                 sum(o_totalprice) AS v FROM texts WHERE d <> 'n/a' GROUP BY 1),
    shown AS (SELECT CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS position,
                     year(p) || 'Q' || quarter(p) AS name, round(v, 4) AS value FROM g) {_TREND}""")
def trend_over_date_text(t):
    texts = t.orders.select(
        F.when(F.col("o_orderstatus") == "P", "n/a")
        .otherwise(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("day"), "o_totalprice")
    return rounded(period_series(texts, "day", "o_totalprice").drop("period_start"), "value")


@query("A23", f"""{_QUARTERS}
    SELECT name, round(value, 2) AS value, {sql_display('value')} AS formatted_value,
           round(abs(value) * 100 / (SELECT sum(abs(value)) FROM shown), 1) AS percentage,
           (SELECT round(sum(value), 2) FROM shown) AS total,
           (SELECT count(*) FROM shown) AS items
    FROM shown ORDER BY value DESC, position LIMIT 1""")
def peak_period(t):
    shown = period_series(t.orders, "o_orderdate", "o_totalprice")
    return rounded(leading_item(shown), "value")


@query("A23", f"SELECT position, name, value FROM ({sql_ranked(_BY_NAME, 12)}) WHERE position <= 3")
def leading_names(t):
    shown = rounded(category_series(t.part, "p_name", "p_retailprice"), "value")
    return leading_rows(shown).select("position", "name", "value")


@query("A24", """
    WITH g AS (SELECT strftime(o_orderdate, '%b %Y') AS name, min(o_orderdate) AS f,
                      sum(o_totalprice) AS value FROM orders GROUP BY 1),
    firsts AS (SELECT * FROM g ORDER BY f LIMIT 12)
    SELECT CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS position, name, round(value, 2) AS value
    FROM firsts""")
def first_months(t):
    return month_totals(t.orders, "o_orderdate", "o_totalprice")


@query("A27", """
    SELECT CAST(l_suppkey AS VARCHAR) AS name, round(sum(l_extendedprice), 2) AS first_value,
           round(sum(l_quantity), 2) AS second_value
    FROM lineitem GROUP BY l_suppkey ORDER BY first_value DESC, l_suppkey LIMIT 12""")
def two_metrics_by_supplier(t):
    shown = compare_metrics(t.lineitem, "l_suppkey", "l_extendedprice", "l_quantity")
    return rounded(shown, "first_value", "second_value")


def _change(t, months):
    found = period_change(t.orders, "o_orderdate", "o_totalprice", months)
    return found.select(period_label(F.col("period_start"), F.lit("month")).alias("name"),
                        "value", "previous", "change_pct")


def _change_sql(months: int) -> str:
    return f"""
    WITH m AS (SELECT date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS v
               FROM orders GROUP BY 1)
    SELECT strftime(a.p, '%Y-%m') AS name, round(a.v, 2) AS value, round(b.v, 2) AS previous,
           round((a.v - b.v) / nullif(abs(b.v), 0) * 100, 2) AS change_pct
    FROM m a LEFT JOIN m b ON b.p = a.p - INTERVAL {months} MONTH"""


@query("W7", _change_sql(1))
def month_over_month(t):
    return _change(t, 1)


@query("W7", _change_sql(12))
def year_over_year(t):
    return _change(t, 12)


@query("W7", """
    WITH m AS (SELECT o_orderstatus, date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS v
               FROM orders GROUP BY 1, 2)
    SELECT a.o_orderstatus, strftime(a.p, '%Y-%m') AS name, round(a.v, 2) AS value,
           round(b.v, 2) AS previous, round((a.v - b.v) / nullif(abs(b.v), 0) * 100, 2) AS change_pct
    FROM m a LEFT JOIN m b ON b.o_orderstatus = a.o_orderstatus AND b.p = a.p - INTERVAL 12 MONTH""")
def year_over_year_by_status(t):
    found = period_change(t.orders, "o_orderdate", "o_totalprice", 12, ["o_orderstatus"])
    return found.select("o_orderstatus",
                        period_label(F.col("period_start"), F.lit("month")).alias("name"),
                        "value", "previous", "change_pct")


@query("W6", """
    SELECT user_id, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20""")
def latest_events_per_user(t):
    return latest_entries(t.events.select("user_id", "event_id"), ["user_id"], ["event_id"], 20)


def _cells_sql(table, d1, d2, metric, k1, k2, func="sum"):
    return f"""
    WITH r AS (SELECT {d1} AS d1, {d2} AS d2, {metric} AS m FROM {table}),
    t1 AS (SELECT d1 FROM r GROUP BY d1 ORDER BY count(*) DESC, d1 LIMIT {k1}),
    t2 AS (SELECT d2 FROM r GROUP BY d2 ORDER BY count(*) DESC, d2 LIMIT {k2}),
    kept AS (SELECT * FROM r SEMI JOIN t1 USING (d1) SEMI JOIN t2 USING (d2)),
    c AS (SELECT d1, d2, {func}(m) AS v FROM kept GROUP BY d1, d2),
    grid AS (SELECT a.d1, b.d2, round(coalesce(c.v, 0), 4) AS v
             FROM (SELECT DISTINCT d1 FROM c) a, (SELECT DISTINCT d2 FROM c) b
             LEFT JOIN c ON c.d1 = a.d1 AND c.d2 = b.d2)"""


_STACKED = """SELECT CAST(d1 AS VARCHAR) AS name, CAST(d2 AS VARCHAR) AS segment,
                     round(v, 2) AS value,
                     round(sum(v) OVER (PARTITION BY d1), 2) AS row_total FROM grid"""
_HEAT = f"""SELECT CAST(d1 AS VARCHAR) AS x, CAST(d2 AS VARCHAR) AS y, round(v, 2) AS value,
                   round(v / max(v) OVER (), 2) AS intensity, {sql_display('v')} AS formatted_value
            FROM grid"""


@query("A12", _cells_sql("part", "p_name", "p_brand", "p_retailprice", 8, 5) + _STACKED)
def stacked_names_by_brand(t):
    shown = stacked_series(t.part, "p_name", "p_brand", "p_retailprice")
    return rounded(shown, "value", "row_total")


@query("A12", _cells_sql("lineitem", "l_returnflag", "l_linestatus", "l_extendedprice", 8, 5, "avg")
       + _STACKED)
def stacked_mean_by_status(t):
    shown = stacked_series(t.lineitem, "l_returnflag", "l_linestatus", "l_extendedprice", "mean")
    return rounded(shown, "value", "row_total")


@query("A12", _cells_sql("lineitem", "l_returnflag", "l_linestatus", "l_extendedprice", 8, 5) + """
    SELECT CAST(d1 AS VARCHAR) AS name, round(sum(v), 2) AS row_total,
           round(sum(v) FILTER (d2 = 'F'), 2) AS "F", round(sum(v) FILTER (d2 = 'O'), 2) AS "O"
    FROM grid GROUP BY d1""")
def pivoted_by_status(t):
    shown = pivoted_series(t.lineitem, "l_returnflag", "l_linestatus", "l_extendedprice")
    return rounded(shown, "F", "O", "row_total")


@query("A13", _cells_sql("part", "p_type", "p_brand", "p_retailprice", 6, 5) + _HEAT)
def heatmap_type_by_brand(t):
    return rounded(heatmap_series(t.part, "p_type", "p_brand", "p_retailprice"), "value")


@query("A13", _cells_sql("lineitem", "l_linenumber", "l_returnflag", "l_quantity", 6, 5, "median")
       + _HEAT)
def heatmap_of_medians(t):
    shown = heatmap_series(t.lineitem, "l_linenumber", "l_returnflag", "l_quantity", "median")
    return rounded(shown, "value")
