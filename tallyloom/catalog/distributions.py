"""Histograms, box statistics and scatter samples."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.registry import query, sql_display
from tallyloom.operators.distribution import box_stats, first_pairs, histogram, scatter_pairs


def histogram_sql(table: str, column: str, bins: int, whole: bool) -> str:
    bound = "format('{{:,}}', CAST(round_even({0}, 0) AS BIGINT))"
    low, high = ((bound.format("lo"), bound.format("hi")) if whole else
                 (sql_display("round(lo, 4)"), sql_display("round(hi, 4)")))
    return f"""
    WITH v AS (SELECT CAST({column} AS DOUBLE) AS v FROM {table} WHERE {column} IS NOT NULL),
    s AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS a,
                 CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS b FROM v),
    e AS (SELECT i, CASE WHEN i = 1 THEN a ELSE (i - 1) * ((b - a) / {bins}) + a END AS lo,
                 CASE WHEN i = {bins} THEN b ELSE i * ((b - a) / {bins}) + a END AS hi
          FROM s, range(1, {bins + 1}) r(i)),
    c AS (SELECT e.i, e.lo, e.hi,
                 count(v.v) FILTER (v.v >= e.lo AND (v.v < e.hi OR e.i = {bins})) AS n
          FROM e, v GROUP BY 1, 2, 3)
    SELECT CAST(i AS INTEGER) AS position, {low} || ' - ' || {high} AS name, n AS value,
           round(lo, 6) AS range_min, round(hi, 6) AS range_max,
           format('{{:,}}', n) || ' records' AS formatted_value FROM c"""


def _edges(shown):
    return shown.withColumns({c: F.round(c, 6) for c in ("range_min", "range_max")})


@query("A15 A16", histogram_sql("lineitem", "l_quantity", 6, True))
def histogram_whole_numbers(t):
    return _edges(histogram(t.lineitem, "l_quantity"))


@query("A15", histogram_sql("lineitem", "l_extendedprice", 6, False))
def histogram_prices(t):
    return _edges(histogram(t.lineitem, "l_extendedprice"))


@query("A15", histogram_sql(
    "(SELECT count(*) AS k FROM orders GROUP BY year(o_orderdate))", "k", 5, True))
def histogram_of_few_rows(t):
    years = t.orders.groupBy(F.year("o_orderdate")).agg(F.count(F.lit(1)).alias("k"))
    return _edges(histogram(years, "k"))


@query("A15", histogram_sql("(SELECT length(o_orderstatus) AS k FROM orders)", "k", 6, True))
def histogram_of_constant(t):
    return _edges(histogram(t.orders.select(F.length("o_orderstatus").alias("k")), "k"))


@query("A15 F16", histogram_sql(
    "(SELECT TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS k FROM part)", "k", 6, True))
def histogram_of_text_numbers(t):
    return _edges(histogram(t.part.select(F.substring("p_brand", 7, 9).alias("k")), "k"))


def _box_sql(groups: str, name: str) -> str:
    q = "round(quantile_cont(m, {0}), 4)"
    return f"""
    {groups}
    SELECT CAST({name} AS VARCHAR) AS name, round(min(m), 4) AS min, {q.format(0.25)} AS q1,
           {q.format(0.5)} AS median, {q.format(0.75)} AS q3, round(max(m), 4) AS max,
           'Median: ' || {sql_display('quantile_cont(m, 0.5)')} AS formatted_value
    FROM r GROUP BY {name} HAVING count(m) >= 2"""


_TOP_BRANDS = """WITH top AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5),
    r AS (SELECT p_brand AS d, p_retailprice AS m FROM part SEMI JOIN top USING (p_brand))"""
_FLAGS = "WITH r AS (SELECT l_returnflag AS d, l_extendedprice AS m FROM lineitem)"


@query("A14", _box_sql(_TOP_BRANDS, "d"))
def box_of_top_brands(t):
    return box_stats(t.part, "p_retailprice", "p_brand")


@query("A14", _box_sql(_FLAGS, "d"))
def box_by_flag(t):
    return box_stats(t.lineitem, "l_extendedprice", "l_returnflag")


@query("A14", _box_sql(_FLAGS, "d"))
def box_by_blocks(t):
    """The path for groups too large for one task."""
    return box_stats(t.lineitem, "l_extendedprice", "l_returnflag")


@query("A14", _box_sql("WITH r AS (SELECT 'o_totalprice' AS d, o_totalprice AS m FROM orders)", "d"))
def box_of_whole_table(t):
    return box_stats(t.orders, "o_totalprice")


@query("A17 P9", f"""
    WITH r AS (SELECT o_orderkey AS k, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y
               FROM orders ORDER BY o_orderkey LIMIT 300),
    n AS (SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS position, x, y FROM r)
    SELECT position, 'Record ' || position AS name, x, y, CAST(100 AS INTEGER) AS z,
           'o_custkey' AS x_label, 'o_totalprice' AS y_label, {sql_display('x')} AS formatted_x,
           {sql_display('y')} AS formatted_y FROM n""")
def scatter_of_first_orders(t):
    return first_pairs(t.orders, "o_custkey", "o_totalprice", ["o_orderkey"])


@query("A26", """
    WITH r AS (SELECT l_extendedprice AS y, nullif(l_discount, 0) AS x, l_orderkey, l_linenumber,
                      l_partkey, l_suppkey FROM lineitem WHERE l_discount <> 0
               ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 30)
    SELECT round(x, 2) AS x, round(y, 2) AS y FROM r""")
def scatter_extract(t):
    with_gaps = t.lineitem.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    pairs = first_pairs(with_gaps, "l_discount", "l_extendedprice",
                        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 30)
    return pairs.select(F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query("A17 S8")
def scatter_sample(t):
    return scatter_pairs(t.orders, "o_custkey", "o_totalprice", ["o_orderkey"])
