"""Trend fits, forecasts, key figures and the overview."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.registry import query, rounded, sql_display, sql_ranked, sql_share
from tallyloom.catalog.distributions import histogram_sql
from tallyloom.operators.forecasting import (
    fit_trend, forecast, forecast_summary, forecast_table, recent_periods,
)
from tallyloom.operators.filters import time_filter
from tallyloom.operators.profiling import column_facts
from tallyloom.operators.quality import quality_score
from tallyloom.plans.overview import key_figures, overview

_BY_STATUS = """
    WITH g AS (SELECT o_orderstatus AS k, date_trunc('quarter', o_orderdate) AS p, sum(o_totalprice) AS y
               FROM orders GROUP BY 1, 2),"""
_BY_TYPE = """
    WITH g AS (SELECT event_type AS k, date_trunc('week', ts) AS p, sum(value) AS y FROM events GROUP BY 1, 2),"""
_ALL = """
    WITH g AS (SELECT 'all' AS k, date_trunc('quarter', o_orderdate) AS p, sum(o_totalprice) AS y
               FROM orders GROUP BY 2),"""
_MONTHS = """
    WITH g AS (SELECT 'all' AS k, date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS y FROM orders
               WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 YEAR GROUP BY 2),"""
_FIT = """
    x AS (SELECT k, p, y, (row_number() OVER (PARTITION BY k ORDER BY p) - 1)::DOUBLE AS x,
                 lag(p) OVER (PARTITION BY k ORDER BY p) AS before FROM g),
    f AS (SELECT k, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS mean,
                 max(p) AS last, date_diff('day', max(before), max(p)) AS gap FROM x GROUP BY k),
    s AS (SELECT f.*, (SELECT sqrt(avg((x.y - (f.b * x.x + f.a)) * (x.y - (f.b * x.x + f.a))))
                       FROM x WHERE x.k = f.k) AS sd FROM f),
    h AS (SELECT s.*, i, greatest(0, b * (n - 1 + i) + a) AS e, 1.96 * sd * sqrt(i) AS w
          FROM s, range(1, 5) r(i))"""
_QUARTER = """'Q' || quarter(last + to_months(3 * i::INTEGER)) || ' ' || year(last + to_months(3 * i::INTEGER))"""
_MONTH = "strftime(last + to_months(i::INTEGER), '%b %Y')"
_WEEK = "'Wk of ' || strftime(last + to_days(7 * i::INTEGER), '%b %d')"


def _forecast_sql(groups: str, label: str, key: str | None) -> str:
    return f"""{groups} {_FIT} SELECT {f'k AS {key}, ' if key else ''} i::INTEGER AS step, {label} AS period,
        round(e, 2) AS expected, round(e + w, 2) AS best_case, round(greatest(0, e - w), 2) AS worst_case
        FROM h"""


@query("K1 K2 W5", f"""{_BY_STATUS} {_FIT}
    SELECT k AS o_orderstatus, n, round(b, 2) AS slope, round(a, 2) AS intercept, round(sd, 2) AS residual_std,
           round(mean, 2) AS mean, strftime(last, '%Y-%m-%d') AS last_at, gap::INTEGER AS gap_days FROM s""")
def trend_fit_by_status(t):
    series = recent_periods(t.orders, "o_orderdate", "o_totalprice", by=["o_orderstatus"])
    fit = fit_trend(series, "value", "period_start", ["o_orderstatus"])
    fit = fit.withColumn("last_at", F.col("last_at").cast("date").cast("string"))
    return rounded(fit, "slope", "intercept", "residual_std", "mean")


@query("K3 K4", _forecast_sql(_BY_STATUS, _QUARTER, "o_orderstatus"))
def forecast_by_status(t):
    return forecast_table(t.orders, "o_orderdate", "o_totalprice", by=["o_orderstatus"])


@query("K3 K4", _forecast_sql(_BY_TYPE, _WEEK, "event_type"))
def forecast_by_event_type(t):
    return forecast_table(t.events, "ts", "value", by=["event_type"])


@query("K3 K4", _forecast_sql(_MONTHS, _MONTH, None))
def forecast_by_month(t):
    recent = time_filter(t.orders, "o_orderdate", "last_n", 1, "year")
    return forecast_table(recent, "o_orderdate", "o_totalprice")


@query("K6", _forecast_sql(_ALL, _QUARTER, None))
def forecast_of_orders(t):
    return forecast_table(t.orders, "o_orderdate", "o_totalprice")


@query("K3", _forecast_sql(_BY_TYPE, "'Period +' || i", "event_type"))
def forecast_over_steps(t):
    """A series whose order is a number has no calendar labels."""
    series = recent_periods(t.events, "ts", "value", by=["event_type"]).select(
        "event_type", F.datediff(F.col("period_start").cast("date"), F.lit("2024-01-01").cast("date"))
        .alias("day"), "value")
    return forecast(series, "value", "day", ["event_type"])


@query("K5", f"""{_BY_STATUS} {_FIT},
    q AS (SELECT k, round(CASE WHEN mean = 0 THEN 1 ELSE mean END, 2) AS historical_mean,
                 round(b / CASE WHEN mean = 0 THEN 1 ELSE mean END * 100, 2) AS growth_pct FROM s),
    d AS (SELECT *, CASE WHEN growth_pct > 2 THEN 'Bullish Growth' WHEN growth_pct < -2 THEN 'Declining'
                    ELSE 'Stable' END AS direction, format('{{:+.1f}}%', growth_pct) AS projected_growth FROM q)
    SELECT k AS o_orderstatus, historical_mean, growth_pct, direction, projected_growth,
           'o_totalprice demonstrates a ' || lower(direction) || ' trajectory projected at '
           || projected_growth || ' change across the next 4 periods.' AS summary FROM d""")
def forecast_summary_by_status(t):
    series = recent_periods(t.orders, "o_orderdate", "o_totalprice", by=["o_orderstatus"])
    return forecast_summary(series, by=["o_orderstatus"], metric_name="o_totalprice")


@query("A22", f"""
    WITH v AS (SELECT round(sum(o_totalprice), 4) AS v, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders)
    SELECT 'o_totalprice' AS title, round(v, 2) AS value, {sql_display('v', before='$')} AS formatted_value,
           'sum' AS aggregation, 'o_custkey' AS second_kpi, c::DOUBLE AS second_value, n AS total_rows,
           100.0::DOUBLE AS data_quality FROM v""")
def key_figures_of_orders(t):
    figures = key_figures(t.orders, "o_totalprice", second="o_custkey", second_func="distinct",
                          quality=quality_score(column_facts(t.orders)), format_type="currency")
    return rounded(figures, "value")


@query("A22 A10", f"""
    WITH v AS (SELECT round(median(l_extendedprice), 4) AS m, round(avg(l_discount), 4) AS v, count(*) AS n FROM lineitem)
    SELECT 'Avg discount_rate' AS title, v AS value, {sql_display('v')} AS formatted_value, 'mean' AS aggregation,
           'l_extendedprice' AS second_kpi, m AS second_value, n AS total_rows, 100.0::DOUBLE AS data_quality FROM v""")
def key_figures_of_rates(t):
    rates = t.lineitem.select(F.col("l_discount").alias("discount_rate"), "l_extendedprice")
    return key_figures(rates, "discount_rate", second="l_extendedprice", second_func="median")


_QUARTERS = """
    WITH g AS (SELECT date_trunc('quarter', o_orderdate) AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1),
    shown AS (SELECT CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS position,
                     year(p) || 'Q' || quarter(p) AS name, round(v, 4) AS value FROM g)"""


def _group_sql(column: str) -> str:
    return sql_ranked(f"SELECT {column} AS name, sum(o_totalprice) AS value FROM orders GROUP BY 1", 12)


@query("A28", f"""
    SELECT 'trend' AS result, position, name, round(value, 2) AS value, share FROM
        ({_QUARTERS} SELECT position, name, value, {sql_share()} AS share FROM shown)
    UNION ALL SELECT 'breakdown', position, name, value, percentage FROM ({_group_sql('o_orderstatus')})
    UNION ALL SELECT 'share', position, name, value, percentage FROM ({_group_sql('o_orderpriority')})
    UNION ALL SELECT 'histogram', position, name, value::DOUBLE, NULL
        FROM ({histogram_sql('orders', 'o_totalprice', 6, False)})
    UNION ALL SELECT 'scatter', position, fx || ' / ' || fy, y, NULL FROM (
        SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS position,
               {sql_display('o_orderkey::DOUBLE')} AS fx, {sql_display('o_custkey::DOUBLE')} AS fy,
               o_custkey::DOUBLE AS y FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 300))""")
def overview_of_orders(t):
    return rounded(overview(t.orders, scatter_order=["o_orderkey"]), "value")
