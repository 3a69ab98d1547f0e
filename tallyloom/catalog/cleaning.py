"""Gaps, spelling, outliers and the whole cleaning plan."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.registry import query
from tallyloom.operators.cleaning import (
    cleaning_summary, date_columns, fill_with_median, fill_with_mode, missing_report,
    normalize_categories, outlier_counts, spelling_report, spellings, value_counts, winsorize,
)
from tallyloom.operators.ordered import order_correlation
from tallyloom.plans.cleanup import clean

# rows with gaps, uneven spelling and repeated content, made from orders
_NOISY = """
    SELECT o_orderstatus AS status,
           nullif(CASE o_orderstatus WHEN 'F' THEN lower(o_orderpriority)
                  WHEN 'O' THEN ' ' || o_orderpriority ELSE o_orderpriority END, ' 2-HIGH') AS priority,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') THEN NULL
                ELSE o_orderstatus END AS sparse,
           CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_custkey END AS customer,
           CASE WHEN o_totalprice > 499000 THEN o_totalprice * 100 ELSE o_totalprice END AS price
    FROM orders"""


def _noisy(t):
    priority = (F.when(F.col("o_orderstatus") == "F", F.lower("o_orderpriority"))
                .when(F.col("o_orderstatus") == "O", F.concat(F.lit(" "), "o_orderpriority"))
                .otherwise(F.col("o_orderpriority")))
    rare = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW")
    return t.orders.select(
        F.col("o_orderstatus").alias("status"), F.nullif(priority, F.lit(" 2-HIGH")).alias("priority"),
        F.when(~rare, F.col("o_orderstatus")).alias("sparse"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_custkey")).alias("customer"),
        F.when(F.col("o_totalprice") > 499000, F.col("o_totalprice") * 100)
        .otherwise(F.col("o_totalprice")).alias("price"))


@query("C2 Q6", """
    SELECT * FROM (VALUES ('o_orderdate', 1.0::DOUBLE, TRUE), ('o_orderstatus', 0.0, FALSE),
                          ('o_orderpriority', 0.0, FALSE)) v("column", parsed_share, is_date)
    UNION ALL SELECT 'order_day', s, s >= 0.5 FROM (
        SELECT round(avg(CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE 1.0 END), 6) AS s FROM orders)
    UNION ALL SELECT 'label', s, s >= 0.8 FROM (
        SELECT round(avg(CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE 1.0 END), 6) AS s FROM orders)""")
def date_columns_found(t):
    text = F.when(F.col("o_orderstatus") == "P", "later").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority",
                           text.alias("order_day"), text.alias("label"))
    return date_columns(rows).withColumn("parsed_share", F.round("parsed_share", 6))


def _missing_sql(column: str, number: bool) -> str:
    how = "'median'" if number else "CASE WHEN m / n::DOUBLE > 0.4 THEN 'skipped_high_missing' ELSE 'mode' END"
    return (f"SELECT '{column}' AS \"column\", m AS missing, round(m / n::DOUBLE, 6) AS missing_share, "
            f"{how} AS strategy FROM (SELECT count(*) - count({column}) AS m, count(*) AS n FROM r) WHERE m > 0")


@query("C6 Q2", f"WITH r AS ({_NOISY}) " + " UNION ALL ".join([
    _missing_sql("priority", False), _missing_sql("sparse", False), _missing_sql("customer", True),
    _missing_sql("price", True)]))
def gaps_reported(t):
    return missing_report(_noisy(t)).withColumn("missing_share", F.round("missing_share", 6))


@query("C3", """
    WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_discount, 0) AS l_discount,
                      nullif(l_tax, 0) AS l_tax FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey,
           coalesce(l_discount, (SELECT median(l_discount) FROM g)) AS l_discount,
           coalesce(l_tax, (SELECT median(l_tax) FROM g)) AS l_tax FROM g""")
def gaps_to_median(t):
    gaps = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
                             F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    return fill_with_median(gaps, ["l_discount", "l_tax"])


@query("C5", """
    WITH g AS (SELECT p_partkey, nullif(p_type, 'SMALL') AS p_type, nullif(p_brand, 'Brand#7') AS p_brand
               FROM part)
    SELECT p_partkey,
           coalesce(p_type, (SELECT p_type FROM g WHERE p_type IS NOT NULL GROUP BY 1
                             ORDER BY count(*) DESC, 1 LIMIT 1)) AS p_type,
           coalesce(p_brand, (SELECT p_brand FROM g WHERE p_brand IS NOT NULL GROUP BY 1
                              ORDER BY count(*) DESC, 1 LIMIT 1)) AS p_brand FROM g""")
def gaps_to_mode(t):
    gaps = t.part.select("p_partkey", F.nullif("p_type", F.lit("SMALL")).alias("p_type"),
                         F.nullif("p_brand", F.lit("Brand#7")).alias("p_brand"))
    return fill_with_mode(gaps, ["p_type", "p_brand"])


_SPELLED = """
    c AS (SELECT trim(v) AS t, count(*) AS n FROM r WHERE v IS NOT NULL GROUP BY 1),
    u AS (SELECT lower(t) AS f, t, row_number() OVER (PARTITION BY lower(t) ORDER BY n DESC, t) AS p FROM c)"""


@query("C7 C8", f"""
    WITH noisy AS ({_NOISY}), r AS (SELECT priority AS v, price FROM noisy), {_SPELLED}
    SELECT u.t AS priority, r.price FROM r LEFT JOIN u ON u.f = lower(trim(r.v)) AND u.p = 1""")
def categories_unified(t):
    return normalize_categories(_noisy(t).select("priority", "price"))


@query("C10", f"""
    WITH noisy AS ({_NOISY}), r AS (SELECT priority AS v FROM noisy), {_SPELLED},
    x AS (SELECT v, u.t AS final, count(*) AS n FROM r JOIN u ON u.f = lower(trim(v)) AND u.p = 1
          WHERE v <> u.t GROUP BY 1, 2)
    SELECT 'priority' AS "column", CAST(sum(n) AS BIGINT) AS values_normalized,
           (SELECT string_agg(v || ' -> ' || final, '; ' ORDER BY v)
            FROM (SELECT * FROM x ORDER BY v LIMIT 5)) AS examples FROM x""")
def category_changes(t):
    found = spelling_report(spellings(value_counts(_noisy(t), ["status", "priority"])))
    return found.withColumn("examples", F.array_join("examples", "; "))


_HOME_SQL = """CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'usa' WHEN 'MACHINERY' THEN 'U.K.'
                    WHEN 'FURNITURE' THEN ' US' ELSE 'Germany' END"""


@query("C9", f"""
    WITH r AS (SELECT c_custkey, {_HOME_SQL} AS home FROM customer)
    SELECT c_custkey, CASE lower(trim(home)) WHEN 'usa' THEN 'United States' WHEN 'us' THEN 'United States'
        WHEN 'u.k.' THEN 'United Kingdom' ELSE trim(home) END AS home FROM r""")
def country_synonyms(t):
    home = (F.when(F.col("c_mktsegment") == "HOUSEHOLD", "usa")
            .when(F.col("c_mktsegment") == "MACHINERY", "U.K.")
            .when(F.col("c_mktsegment") == "FURNITURE", " US").otherwise("Germany"))
    return normalize_categories(t.customer.select("c_custkey", home.alias("home")))


def _outlier_sql(column: str) -> str:
    return f"""
    SELECT '{column}' AS "column", round(m, 4) AS mean, round(s, 4) AS std,
           (SELECT count(*) FROM r WHERE abs(({column} - m) / s) > 3) AS outliers
    FROM (SELECT avg({column}) AS m, stddev_samp({column}) AS s FROM r)"""


@query("C11", f"WITH r AS ({_NOISY}) {_outlier_sql('price')} UNION ALL {_outlier_sql('customer')}")
def outliers_counted(t):
    found = outlier_counts(_noisy(t))
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query("C12", f"""
    WITH r AS ({_NOISY}),
    q AS (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM r)
    SELECT customer, round(greatest(least(price, hi), lo), 4) AS price FROM r, q""")
def outliers_clipped(t):
    return winsorize(_noisy(t).select("customer", "price")).withColumn(
        "price", F.round("price", 4))


# average ranks of the values against the row number among rows with a value
_RANKED = """
    WITH g AS (SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE {0} END AS v FROM events),
    k AS (SELECT v, row_number() OVER (ORDER BY event_id) AS p FROM g WHERE v IS NOT NULL),
    a AS (SELECT p, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM k)
    SELECT '{1}' AS "column", count(*) AS n, round(corr(r, p), 6) AS spearman FROM a"""


@query("W4", " UNION ALL ".join(f"({_RANKED.format(e, n)})" for n, e in [
    ("rising", "event_id * 0.01 + value"), ("value", "value"), ("falling", "-event_id")]))
def order_correlations(t):
    known = F.col("event_type") != "click"
    rows = t.events.select("event_id", *[F.when(known, F.expr(e)).alias(n) for n, e in [
        ("rising", "event_id * 0.01 + value"), ("value", "value"), ("falling", "-event_id")]])
    found = order_correlation(rows, ["rising", "value", "falling"], ["event_id"])
    return found.withColumn("spearman", F.round("spearman", 6))


# the cleaning steps one after the other, as in the plan
_CLEAN = f"""
    WITH noisy AS ({_NOISY}), d AS (SELECT DISTINCT * FROM noisy),
    md AS (SELECT median(customer) AS customer FROM d),
    mo AS (SELECT priority FROM d WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    f AS (SELECT status, coalesce(d.priority, mo.priority) AS priority, sparse,
                 coalesce(CAST(d.customer AS DOUBLE), md.customer) AS customer, price FROM d, md, mo),
    c AS (SELECT trim(priority) AS t, count(*) AS n FROM f GROUP BY 1),
    u AS (SELECT lower(t) AS fold, t FROM c
          QUALIFY row_number() OVER (PARTITION BY lower(t) ORDER BY n DESC, t) = 1),
    s AS (SELECT f.status, u.t AS priority, f.priority AS unclean, f.sparse, f.customer, f.price
          FROM f JOIN u ON u.fold = lower(trim(f.priority))),
    z AS (SELECT avg(price) AS m, stddev_samp(price) AS sd, quantile_cont(price, 0.01) AS lo,
                 quantile_cont(price, 0.99) AS hi FROM s),
    o AS (SELECT count(*) AS n FROM s, z WHERE abs((price - m) / sd) > 3)"""


@query("C13 C4", _CLEAN + """
    SELECT status, priority, sparse, customer,
           round(CASE WHEN o.n > 0 THEN greatest(least(price, hi), lo) ELSE price END, 4) AS price
    FROM s, z, o""")
def cleaned_table(t):
    frame, _ = clean(_noisy(t))
    return frame.withColumn("price", F.round("price", 4))


_REPORT = _CLEAN + """,
    rep AS (
    SELECT NULL AS "column", 'rows' AS step, 'initial' AS action, (SELECT count(*) FROM noisy) AS "count"
    UNION ALL SELECT NULL, 'rows', 'cleaned', (SELECT count(*) FROM d)
    UNION ALL SELECT NULL, 'duplicates', 'removed', (SELECT count(*) FROM noisy) - (SELECT count(*) FROM d)
    UNION ALL SELECT 'priority', 'missing', 'mode', (SELECT count(*) FROM d WHERE priority IS NULL)
    UNION ALL SELECT 'sparse', 'missing', 'skipped_high_missing', (SELECT count(*) FROM d WHERE sparse IS NULL)
    UNION ALL SELECT 'customer', 'missing', 'median', (SELECT count(*) FROM d WHERE customer IS NULL)
    UNION ALL SELECT 'priority', 'categories', 'normalized', (SELECT count(*) FROM s WHERE unclean <> priority)
    UNION ALL SELECT 'customer', 'outliers', 'none', 0
    UNION ALL SELECT 'price', 'outliers', CASE WHEN n > 0 THEN 'winsorized_1_99' ELSE 'none' END, n FROM o)"""


@query("C10 C13", _REPORT + ' SELECT "column", step, action, "count" FROM rep')
def cleaning_report(t):
    _, report = clean(_noisy(t))
    return report.filter(F.col("step") != "example").select("column", "step", "action", "count")


@query("C19", _REPORT + """
    SELECT step AS section, "column", CASE
        WHEN step = 'rows' THEN 'Rows ' || action || ': ' || "count"
        WHEN step = 'duplicates' THEN 'Duplicates removed: ' || "count"
        WHEN action = 'skipped_high_missing' THEN "column" || ': '
            || round("count" * 100.0 / (SELECT count(*) FROM d), 1)::DOUBLE
            || '% missing — left as-is, flagged for review'
        WHEN step = 'missing' THEN "column" || ': ' || action || '-imputed (' || "count" || ' missing values)'
        WHEN step = 'outliers' THEN "column" || ': ' || "count" || ' outliers capped at 1st/99th percentile'
        ELSE "column" || ': ' || "count" || ' values normalized' END AS sentence
    FROM rep WHERE NOT (step = 'outliers' AND action = 'none')""")
def cleaning_sentences(t):
    _, report = clean(_noisy(t))
    return cleaning_summary(report)
