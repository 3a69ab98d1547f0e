"""Aggregates, counts of distinct rows and values, top rows."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.catalog.registry import query, rounded
from tallyloom.operators.aggregate import aggregate
from tallyloom.operators.cleaning import drop_duplicate_rows, duplicate_report
from tallyloom.operators.filters import keep_top_values, top_values
from tallyloom.operators.staging import shared_folder
from tallyloom.sources.preview import fenced_page, page_fences, sample_records, sample_rows
from tallyloom.sources.tables import read_table, union_tables, write_table


def _by_flag(t, metric, func, places=4):
    return rounded(aggregate(t.lineitem, metric, func, ["l_returnflag"]), "value", places=places)


def _flag_sql(expression: str, places: int = 4) -> str:
    return (f"SELECT l_returnflag, round(CAST({expression} AS DOUBLE), {places}) AS value "
            "FROM lineitem GROUP BY l_returnflag")


@query("A1 P10", _flag_sql("sum(l_extendedprice)", 2))
def agg_sum_by_flag(t):
    return _by_flag(t, "l_extendedprice", "sum", 2)


@query("A2", _flag_sql("avg(l_discount)"))
def agg_mean_by_flag(t):
    return _by_flag(t, "l_discount", "average")


@query("A3", _flag_sql("median(l_extendedprice)"))
def agg_median_by_flag(t):
    return _by_flag(t, "l_extendedprice", "median")


@query("A3", _flag_sql("median(l_extendedprice)"))
def agg_median_by_blocks(t):
    """The path for groups too large for one task."""
    found = aggregate(t.lineitem, "l_extendedprice", "median", ["l_returnflag"])
    return rounded(found, "value", places=4)


@query("A4", "SELECT l_returnflag, count(nullif(l_tax, 0)) AS value FROM lineitem "
             "GROUP BY l_returnflag")
def agg_count_by_flag(t):
    with_gaps = t.lineitem.withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    return aggregate(with_gaps, "l_tax", "count", ["l_returnflag"])


@query("A5", "SELECT l_returnflag, count(DISTINCT l_partkey) AS value FROM lineitem "
             "GROUP BY l_returnflag")
def agg_count_distinct_by_flag(t):
    return aggregate(t.lineitem, "l_partkey", "unique", ["l_returnflag"])


@query("A6", _flag_sql("min(l_extendedprice)"))
def agg_min_by_flag(t):
    return _by_flag(t, "l_extendedprice", "minimum")


@query("A7", _flag_sql("max(l_extendedprice)"))
def agg_max_by_flag(t):
    return _by_flag(t, "l_extendedprice", "max")


@query("A8", "SELECT o_custkey, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS value "
             "FROM orders GROUP BY o_custkey")
def agg_std_by_customer(t):
    """A customer with one order has deviation 0."""
    return rounded(aggregate(t.orders, "o_totalprice", "std", ["o_custkey"]), "value", places=4)


_WHOLE = {
    "sum": "round(CAST(sum(l_quantity) AS DOUBLE), 2)",
    "mean": "round(avg(l_quantity), 4)",
    "median": "round(median(l_quantity), 4)",
    "count": "CAST(count(l_quantity) AS DOUBLE)",
    "count_distinct": "CAST(count(DISTINCT l_quantity) AS DOUBLE)",
    "min": "min(l_quantity)",
    "max": "max(l_quantity)",
    "std": "round(stddev_samp(l_quantity), 4)",
}


@query("A1 A2 A3 A4 A5 A6 A7 A8", " UNION ALL ".join(
    f"SELECT '{f}' AS func, {e} AS value FROM lineitem" for f, e in _WHOLE.items()))
def agg_whole_table(t):
    parts = [
        aggregate(t.lineitem, "l_quantity", f).select(
            F.lit(f).alias("func"), F.round(F.col("value").cast("double"), 4).alias("value"))
        for f in _WHOLE
    ]
    return reduce(DataFrame.unionByName, parts)


@query("A1", """
    SELECT nullif(l_returnflag, 'N') AS flag,
           round(coalesce(sum(CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity END), 0), 2)
               AS value
    FROM lineitem GROUP BY 1""")
def agg_sum_with_gaps(t):
    """A missing group is kept, and a group of gaps sums to 0."""
    rows = t.lineitem.select(
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        F.when(F.col("l_returnflag") == "A", None).otherwise(F.col("l_quantity")).alias("qty"))
    return rounded(aggregate(rows, "qty", "sum", ["flag"]), "value")


@query("A2 A10", "SELECT l_returnflag, round(avg(l_discount), 4) AS value FROM lineitem "
                 "GROUP BY l_returnflag")
def agg_auto_averages_rates(t):
    rates = t.lineitem.withColumnRenamed("l_discount", "discount_rate")
    found = aggregate(rates, "discount_rate", "auto", ["l_returnflag"])
    return rounded(found, "value", places=4)


@query("U2 C1", """
    SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount
    FROM lineitem""")
def distinct_rows(t):
    return drop_duplicate_rows(t.lineitem.select(
        "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount"))


@query("C1", """
    WITH d AS (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem),
    n AS (SELECT (SELECT count(*) FROM lineitem) AS rows_before, (SELECT count(*) FROM d) AS rows_after)
    SELECT rows_before, rows_after, rows_before - rows_after AS duplicates_removed FROM n""")
def duplicate_rows_report(t):
    return duplicate_report(t.lineitem.select(
        "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"))


@query("U3", "SELECT DISTINCT p_brand FROM part")
def distinct_brands(t):
    return t.part.select("p_brand").distinct()


@query("U1 S2", """
    SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_name, s_nationkey, s_acctbal FROM supplier""")
def union_of_accounts(t):
    return union_tables(
        t.customer.selectExpr("c_name name", "c_nationkey nation", "c_acctbal balance"),
        t.supplier.selectExpr("s_name name", "s_nationkey nation",
                              "s_acctbal balance"))


@query("T3 F17", """
    WITH top AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5)
    SELECT p_partkey, p_brand, p_retailprice FROM part SEMI JOIN top USING (p_brand)""")
def rows_of_top_brands(t):
    return keep_top_values(t.part, "p_brand", 5).select("p_partkey", "p_brand", "p_retailprice")


@query("T3", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 10")
def most_frequent_names(t):
    return top_values(t.part, "p_name", 10)


@query("S6", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey "
             "LIMIT 50 OFFSET 100")
def preview_third_page(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    rows, _ = fenced_page(orders, page_fences(orders, ["o_orderkey"]), 3, 50)
    return rows


@query("S6", """SELECT o_orderkey, o_custkey, o_totalprice FROM (
    SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r,
           least(290, ceil(count(*) OVER () / 50.0)) AS shown FROM orders) WHERE r > (shown - 1) * 50 AND r <= shown * 50""")
def preview_far_page(t):
    """A page near the end (or the last page of a smaller table), by a page index: only its blocks
    are read and numbered."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    order = ["o_totalprice", "o_orderkey"]
    rows, _ = fenced_page(orders, page_fences(orders, order), 290, 50)
    return rows


@query("S7", "SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') "
             "AS o_orderdate FROM orders ORDER BY o_orderkey LIMIT 5")
def first_records(t):
    return sample_records(t.orders, ["o_orderkey"]).select(
        "o_orderkey", "o_orderstatus", "o_orderdate")


@query("S8")
def repeatable_sample(t):
    return sample_rows(t.lineitem, 2000, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("S1 S3 S4 S5", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def exported_and_read_back(t):
    """CSV out to the shared folder and in again, with the types given."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                           "o_orderpriority")
    path = f"{shared_folder(t.spark)}/tallyloom/{uuid.uuid4().hex}_cleaned.csv"
    write_table(rows, path)
    return read_table(t.spark, path, schema=rows.schema)
