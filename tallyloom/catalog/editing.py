"""Edits of a table, number display and fills of one column."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.registry import query, sql_display
from tallyloom.functions.columns import clean_number
from tallyloom.functions.display import display_number
from tallyloom.operators.actions import (
    add_column, apply_actions, change_type, drop_column, fill_missing, rename_column,
)
from tallyloom.operators.profiling import profile


@query("P1", "SELECT p_partkey, p_name, p_type FROM part")
def column_dropped(t):
    return drop_column(t.part.select("p_partkey", "p_name", "p_brand", "p_type"), "p_brand")


@query("P2", "SELECT c_custkey, c_acctbal AS balance, c_mktsegment FROM customer")
def column_renamed(t):
    return rename_column(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"),
                         "c_acctbal", "balance")


@query("P3", """
    SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
           CAST(regexp_extract(o_orderpriority, '^\\d') AS BIGINT) AS urgency,
           CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
           CAST(o_orderkey AS DOUBLE) AS key_number FROM orders""")
def types_changed(t):
    texts = t.orders.select(
        "o_orderkey", "o_custkey", F.regexp_extract("o_orderpriority", r"^\d", 0).alias("urgency"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"),
        F.col("o_orderkey").cast("string").alias("key_number"))
    out = change_type(texts, "o_custkey", "string")
    out = change_type(change_type(out, "urgency", "int"), "day", "datetime")
    out = change_type(out, "key_number", "float")
    return out.withColumn("day", F.col("day").cast("date").cast("string"))


@query("P3", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_extendedprice = floor(l_extendedprice)
                THEN CAST(l_extendedprice AS BIGINT) END AS whole_price FROM lineitem""")
def whole_numbers_only(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             F.col("l_extendedprice").alias("whole_price"))
    return change_type(rows, "whole_price", "int", strict=False)


@query("P4 P5", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
           round(l_extendedprice / nullif(l_discount, 0), 6) AS ratio
    FROM lineitem""")
def columns_added(t):
    out = add_column(t.lineitem, "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    out = add_column(out, "ratio", "l_extendedprice / l_discount")
    return out.select("l_orderkey", "l_linenumber", "l_partkey",
                      F.round("charge", 6).alias("charge"), F.round("ratio", 6).alias("ratio"))


@query("P6", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS quantity,
           round(l_extendedprice / nullif(l_quantity, 0), 8) AS unit_price
    FROM lineitem WHERE l_returnflag = 'R'""")
def actions_applied(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                             "l_extendedprice", "l_returnflag")
    out = apply_actions(rows, [
        {"type": "filter_rows",
         "params": {"column": "l_returnflag", "operator": "==", "value": "R"}},
        {"type": "rename_column", "params": {"column": "l_quantity", "new_name": "quantity"}},
        {"type": "add_column",
         "params": {"new_column": "unit_price", "expression": "l_extendedprice / quantity"}},
        {"type": "drop_column", "params": {"column": "l_extendedprice"}},
        {"type": "drop_column", "params": {"column": "l_returnflag"}},
    ])
    return out.withColumn("unit_price", F.round("unit_price", 8))


@query("P6 Q16", """
    SELECT 'o_custkey' AS "column", 0.0::DOUBLE AS missing_pct, count(DISTINCT o_custkey) AS unique_count,
           'measure' AS semantic_role FROM orders WHERE o_orderstatus = 'F'
    UNION ALL
    SELECT 'paid', 0.0, count(DISTINCT o_totalprice), 'measure' FROM orders WHERE o_orderstatus = 'F'""")
def profile_after_actions(t):
    edited = apply_actions(t.orders.select("o_custkey", "o_orderstatus", "o_totalprice"), [
        {"type": "filter_rows",
         "params": {"column": "o_orderstatus", "operator": "==", "value": "F"}},
        {"type": "rename_column", "params": {"column": "o_totalprice", "new_name": "paid"}},
        {"type": "drop_column", "params": {"column": "o_orderstatus"}},
    ])
    return profile(edited).select("column", "missing_pct", "unique_count", "semantic_role")


@query("P7", """
    SELECT p_partkey, round(coalesce(TRY_CAST(substr(p_brand, 7) AS DOUBLE) / nullif(p_size - 10, 0), 0), 4)
        AS number FROM part""")
def numbers_cleaned(t):
    code = F.substring("p_brand", 7, 9).try_cast("double")
    return t.part.select("p_partkey", clean_number(
        F.try_divide(code, F.col("p_size") - 10)).alias("number"))


_DISPLAYED = {
    "plain": ("value", {}),
    "small": ("value / 100", {}),
    "large": ("value * 1000", {"before": "$"}),
    "huge": ("value * 1000000", {"after": " kg"}),
    "share": ("value * 100", {"after": "%", "percent": True}),
}
_UNITS = {"plain": {}, "small": {}, "large": {"format_type": "currency"}, "huge": {"unit": "kg"},
          "share": {"format_type": "percentage"}}


@query("P8", "WITH e AS (SELECT event_id, value FROM events) SELECT event_id, " + ", ".join(
    f"{sql_display(f'round({e}, 4)', **o)} AS {n}" for n, (e, o) in _DISPLAYED.items()) + " FROM e")
def numbers_displayed(t):
    numbers = t.events.select("event_id", *[
        clean_number(F.expr(e)).alias(n) for n, (e, _) in _DISPLAYED.items()])
    return numbers.select("event_id", *[
        display_number(F.col(n), **_UNITS[n]).alias(n) for n in _DISPLAYED])


def _gaps(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_returnflag", F.lit("A")).alias("l_returnflag"))


def _filled_sql(column: str, fill: str) -> str:
    return f"""
    WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                      nullif(l_discount, 0) AS l_discount, nullif(l_returnflag, 'A') AS l_returnflag
               FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {fill} AS {column} FROM g"""


def _filled(t, column, strategy, **options):
    out = fill_missing(_gaps(t), column, strategy, **options)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", column)


@query("C14", _filled_sql("l_discount", "round(coalesce(l_discount, (SELECT avg(l_discount) FROM g)), 6)"))
def filled_with_mean(t):
    return _filled(t, "l_discount", "mean").withColumn("l_discount", F.round("l_discount", 6))


@query("C15", _filled_sql("l_discount", "coalesce(l_discount, (SELECT median(l_discount) FROM g))"))
def filled_with_median(t):
    return _filled(t, "l_discount", "median")


@query("C16", _filled_sql("l_returnflag", """coalesce(l_returnflag,
    (SELECT l_returnflag FROM g WHERE l_returnflag IS NOT NULL GROUP BY 1
     ORDER BY count(*) DESC, 1 LIMIT 1))"""))
def filled_with_mode(t):
    return _filled(t, "l_returnflag", "mode")


@query("C17", _filled_sql("l_returnflag", "coalesce(l_returnflag, 'none')"))
def filled_with_constant(t):
    return _filled(t, "l_returnflag", "constant", value="none")


@query("C17", _filled_sql("l_discount", "coalesce(l_discount, 0)"))
def filled_with_zero(t):
    return _filled(t, "l_discount", "zero")


_TREND_GAPS = """
    WITH g AS (SELECT event_id, event_type,
                      CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE event_id * 1.5 + value END AS level
               FROM events)"""


def _trend_gaps(t):
    level = F.when(~F.col("event_type").isin("click", "view"), F.col("event_id") * 1.5 + F.col("value"))
    return t.events.select("event_id", "event_type", level.alias("level"))


@query("W3 C18", _TREND_GAPS + """
    SELECT event_id, event_type, round(last_value(level IGNORE NULLS) OVER (
        ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS level FROM g""")
def filled_forward(t):
    out = fill_missing(_trend_gaps(t), "level", "forward_fill", order_by=["event_id"])
    return out.withColumn("level", F.round("level", 4))


@query("W3 C18", """
    WITH g AS (SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS level
               FROM events)
    SELECT event_id, user_id, last_value(level IGNORE NULLS) OVER (
        PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        AS level FROM g""")
def filled_forward_per_user(t):
    level = F.when(F.col("event_type") != "click", F.col("value"))
    gaps = t.events.select("event_id", "user_id", level.alias("level"))
    return fill_missing(gaps, "level", "forward_fill", order_by=["event_id"],
                        partition_by=["user_id"])
