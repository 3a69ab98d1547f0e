"""Profiles, roles, personal data, correlation, quality and drift."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.registry import QUERIES, query, rounded
from tallyloom.functions.fixed import PII_VALUE_PATTERNS
from tallyloom.operators.privacy import mask_columns, masked_preview, personal_data
from tallyloom.operators.profiling import (
    column_facts, distinct_values, kpi_columns, profile, table_size,
)
from tallyloom.operators.quality import (
    correlation_matrix, drift, quality_breakdown, quality_score,
)
from tallyloom.operators import sketches
from tallyloom.operators.staging import new_folder
from tallyloom.plans.cleanup import clean


@query("Q1", "SELECT count(*) AS row_count, 11::BIGINT AS column_count FROM lineitem")
def size_of_lineitem(t):
    return table_size(t.lineitem)


_GAPS = """SELECT l_quantity, nullif(l_discount, 0) AS l_discount, nullif(l_returnflag, 'A') AS l_returnflag,
                  CAST(NULL AS DOUBLE) AS nothing FROM lineitem"""


def _gaps(t):
    return t.lineitem.select(
        "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_returnflag", F.lit("A")).alias("l_returnflag"),
        F.lit(None).cast("double").alias("nothing"))


def _facts_sql(position: int, column: str, kind: str, number: bool) -> str:
    stats = ", ".join(
        (f"round(coalesce({f}({column}), 0), 6) AS {n}" if number else f"NULL AS {n}")
        for f, n in [("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")])
    return (f"SELECT CAST({position} AS INTEGER) AS position, '{column}' AS \"column\", '{kind}' AS type, "
            f"round((count(*) - count({column})) * 100.0 / count(*), 2)::DOUBLE AS missing_pct, {stats}, FALSE AS is_date FROM r")


@query("Q2 Q5", f"WITH r AS ({_GAPS}) " + " UNION ALL ".join([
    _facts_sql(0, "l_quantity", "double", True), _facts_sql(1, "l_discount", "double", True),
    _facts_sql(2, "l_returnflag", "string", False), _facts_sql(3, "nothing", "double", True)]))
def column_facts_with_gaps(t):
    return rounded(column_facts(_gaps(t)), "mean", "std", "min", "max", places=6)


def _distinct_sql(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS unique_count,
            (SELECT string_agg(v, ', ' ORDER BY v) FROM (
                SELECT DISTINCT {e} AS v FROM {table} WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 3)) AS sample_values
            FROM (SELECT DISTINCT {c} FROM {table} WHERE {c} IS NOT NULL)""" for c, e in columns.items())


@query("Q3 Q4", _distinct_sql("orders", {
    "o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_custkey": "CAST(o_custkey AS VARCHAR)",
    "o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"}))
def distinct_values_of_orders(t):
    found = distinct_values(t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    return found.withColumn("sample_values", F.array_join("sample_values", ", "))


_PROFILED = ("position", "column", "type", "missing_pct", "unique_count", "mean", "std", "min", "max",
             "median", "semantic_role", "default_aggregation", "kpi_confidence", "geo_confidence")


def _profile_sql(table: str, columns: list[tuple]) -> str:
    """One row per (column, type, role, aggregation, kpi confidence, geo confidence)."""
    parts = []
    for i, (c, kind, role, func, kpi, geo) in enumerate(columns):
        number = kind in ("int", "bigint", "double")
        stats = ", ".join(
            f"round(coalesce({f}({c}), 0)::DOUBLE, 4) AS {n}" if number else f"NULL::DOUBLE AS {n}"
            for f, n in [("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"),
                         ("median", "median")])
        text = [f"'{x}'" if x is not None else "NULL" for x in (role, func)]
        score = [f"{x}::DOUBLE" if x is not None else "NULL::DOUBLE" for x in (kpi, geo)]
        parts.append(
            f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column", '{kind}' AS type,
            round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS missing_pct,
            count(DISTINCT {c}) AS unique_count, {stats}, {text[0]} AS semantic_role,
            {text[1]} AS default_aggregation, {score[0]} AS kpi_confidence, {score[1]} AS geo_confidence
            FROM {table}""")
    return " UNION ALL ".join(parts)


def _profiled(df):
    found = profile(df).select(*_PROFILED)
    return rounded(found, "mean", "std", "min", "max", "median", places=4)


_ORDERS_PROFILE = _profile_sql("orders", [
    ("o_orderkey", "bigint", "measure", "sum", 0.25, None),
    ("o_custkey", "bigint", "measure", "sum", 0.25, None),
    ("o_orderstatus", "string", "dimension", None, None, 0.0),
    ("o_totalprice", "double", "kpi", "sum", 1.0, None),
    ("o_orderdate", "timestamp_ntz", "date", None, None, None),
    ("o_orderpriority", "string", "dimension", None, None, 0.0)])
_LINES_PROFILE = _profile_sql("lineitem", [
    ("l_quantity", "double", "kpi", "sum", 0.6, None),
    ("l_extendedprice", "double", "kpi", "sum", 1.0, None),
    ("l_discount", "double", "measure", "sum", 0.25, None),
    ("l_linenumber", "int", "measure", "sum", 0.25, None),
    ("l_returnflag", "string", "dimension", None, None, 0.0),
    ("l_linestatus", "string", "dimension", None, None, 0.0)])


@query("Q5 Q6 Q8 Q9", _ORDERS_PROFILE)
def profile_of_orders(t):
    return _profiled(t.orders)


@query("Q6 Q7 Q8 Q9", _profile_sql("events", [
    ("event_id", "bigint", "identifier", "count", 0.0, None),
    ("ts", "timestamp_ntz", "date", None, None, None),
    ("user_id", "bigint", "identifier", "count", 0.0, None),
    ("event_type", "string", "dimension", None, None, 0.0),
    ("value", "double", "measure", "sum", 0.25, None),
    ("props", "string", "dimension", None, None, 0.0)]))
def profile_of_events(t):
    return _profiled(t.events)


@query("Q7 Q8 Q9", _profile_sql(
    """(SELECT year(o_orderdate)::BIGINT AS order_year, o_totalprice AS score, o_custkey AS age,
        o_totalprice AS churn, CASE o_orderstatus WHEN 'F' THEN 'US' WHEN 'O' THEN 'DE' ELSE 'FR' END AS home,
        o_orderstatus AS city FROM orders)""", [
        ("order_year", "bigint", "temporal_discrete", "count", 0.0, None),
        ("score", "double", "kpi", "mean", 0.75, None),
        ("age", "bigint", "measure", "mean", 0.35, None),
        ("churn", "double", "kpi", "mean", 0.85, None),
        ("home", "string", "geographical", None, None, 0.5),
        ("city", "string", "geographical", None, None, 1.0)]))
def profile_by_name_and_values(t):
    return _profiled(t.orders.select(
        F.year("o_orderdate").cast("bigint").alias("order_year"),
        F.col("o_totalprice").alias("score"), F.col("o_custkey").alias("age"),
        F.col("o_totalprice").alias("churn"),
        F.when(F.col("o_orderstatus") == "F", "US").when(F.col("o_orderstatus") == "O", "DE")
        .otherwise("FR").alias("home"), F.col("o_orderstatus").alias("city")))


@query("Q15 T5", f"""
    SELECT CAST(row_number() OVER (ORDER BY kpi_confidence DESC, position) AS INTEGER) AS rank,
           "column", kpi_confidence FROM ({_LINES_PROFILE}) WHERE kpi_confidence > 0""")
def kpis_of_lineitem(t):
    return kpi_columns(profile(t.lineitem.select(
        "l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_returnflag",
        "l_linestatus")))


_PERSONS = """SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@example.com' AS contact,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'none'
         ELSE '555-' || substr(c_name, 13, 3) || '-' || substr(c_name, 15, 4) END AS phone,
    substr(c_name, 10, 3) || '-' || substr(c_name, 13, 2) || '-' || substr(c_name, 15, 4) AS code,
    '10.0.' || c_nationkey || '.' || c_nationkey AS host, c_mktsegment FROM customer"""


def _persons(t):
    part = lambda start, n: F.substring("c_name", start, n)
    return t.customer.select(
        "c_custkey",
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
        .alias("contact"),
        F.when(F.col("c_mktsegment") == "BUILDING", "none").otherwise(
            F.concat(F.lit("555-"), part(13, 3), F.lit("-"), part(15, 4))).alias("phone"),
        F.concat(part(10, 3), F.lit("-"), part(13, 2), F.lit("-"), part(15, 4)).alias("code"),
        F.concat(F.lit("10.0."), F.col("c_nationkey"), F.lit("."), F.col("c_nationkey"))
        .alias("host"),
        "c_mktsegment")


_PATTERN_OF = {kind: pattern for pattern, kind, _ in PII_VALUE_PATTERNS}


def _pii_sql(column: str, named: str | None, named_score: float, kind: str, score: float) -> str:
    hits = f"(SELECT count(*) FROM r WHERE regexp_matches({column}, '{_PATTERN_OF[kind]}'))"
    before = f"'column name matches {named} pattern; ' || " if named else ""
    return f"""
    SELECT '{column}' AS "column", {before}h || '/' || n || ' values match {kind} format' AS reason,
           round(greatest({named_score}, {score} * least(1.0, h / n::DOUBLE * 2)), 2)::DOUBLE AS confidence,
           '{kind}' AS kind
    FROM (SELECT {hits} AS h, (SELECT count({column}) FROM r) AS n)"""


@query("Q10", f"WITH r AS ({_PERSONS}) " + " UNION ALL ".join([
    _pii_sql("contact", None, 0.0, "email", 0.95), _pii_sql("phone", "phone", 0.9, "phone", 0.9),
    _pii_sql("code", None, 0.0, "ssn", 0.95), _pii_sql("host", None, 0.0, "ip_address", 0.8)]))
def personal_data_found(t):
    return personal_data(_persons(t))


_MASKED = r"""
    c_custkey, substr(contact, 1, 1) || '***@***.com' AS contact,
    CASE WHEN phone = 'none' THEN '***-***-****' ELSE '***-***-' || right(phone, 4) END AS phone,
    '***-**-' || right(code, 4) AS code, '***.***.***.' || split_part(host, '.', 4) AS host"""


@query("Q11", f"WITH r AS ({_PERSONS}) SELECT {_MASKED}, '**** **** **** ' || right(c_mktsegment, 4) "
              "AS card, substr(c_mktsegment, 1, 1) || '***' AS c_mktsegment FROM r")
def personal_data_masked(t):
    rows = _persons(t).withColumn("card", F.col("c_mktsegment"))
    return mask_columns(rows, {"contact": "email", "phone": "phone", "code": "ssn",
                               "host": "ip_address", "card": "credit_card", "c_mktsegment": "name"})


@query("Q11", f"WITH r AS ({_PERSONS}), m AS (SELECT {_MASKED} FROM r) "
              "SELECT contact, phone, code, host FROM m ORDER BY c_custkey LIMIT 5")
def masked_first_rows(t):
    return masked_preview(_persons(t), ["c_custkey"])


_CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "same"]


@query("Q12", """WITH r AS (SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, 1.0::DOUBLE AS same
               FROM lineitem) """ + " UNION ALL ".join(
    f"""SELECT '{a}' AS col_a, '{b}' AS col_b,
        round(CASE WHEN isnan(c) THEN 0 ELSE coalesce(c, 0) END, 2)::DOUBLE AS r
        FROM (SELECT {'max(0.0::DOUBLE)' if 'same' in (a, b) else f'corr({a}, {b})'} AS c FROM r)"""
    for a in _CORRELATED for b in _CORRELATED))
def correlations_of_lineitem(t):
    rows = t.lineitem.select("l_quantity", "l_extendedprice",
                             F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
                             F.lit(1.0).alias("same"))
    return correlation_matrix(rows)


@query("Q13", f"""WITH r AS ({_GAPS}), p AS (
    SELECT (count(*) - count(l_quantity)) * 100.0 / count(*) AS a, (count(*) - count(l_discount)) * 100.0 / count(*) AS b,
           (count(*) - count(l_returnflag)) * 100.0 / count(*) AS c, 100.0 AS d FROM r)
    SELECT round(100 - (round(a, 2) + round(b, 2) + round(c, 2) + d) / 4, 1)::DOUBLE AS quality_score FROM p""")
def quality_of_gaps(t):
    return quality_score(profile(_gaps(t)))


@query("Q13", f"""
    WITH p AS ({_LINES_PROFILE}),
    r AS (SELECT DISTINCT l_quantity, l_extendedprice, l_discount, l_linenumber, l_returnflag, l_linestatus FROM lineitem),
    z AS (SELECT (SELECT max(abs((l_quantity - m) / s)) > 3 FROM r, (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM r))::INT
               + (SELECT max(abs((l_extendedprice - m) / s)) > 3 FROM r, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM r))::INT
               + (SELECT max(abs((l_discount - m) / s)) > 3 FROM r, (SELECT avg(l_discount) AS m, stddev_samp(l_discount) AS s FROM r))::INT
               + (SELECT max(abs((l_linenumber - m) / s)) > 3 FROM r, (SELECT avg(l_linenumber) AS m, stddev_samp(l_linenumber) AS s FROM r))::INT AS treated)
    SELECT 100.0::DOUBLE AS completeness, round(100 * (1 - treated / 4.0), 1)::DOUBLE AS consistency,
           (SELECT round(avg(coalesce(kpi_confidence, geo_confidence)) * 100, 1) FROM p) AS type_confidence FROM z""")
def quality_breakdown_of_lineitem(t):
    rows = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_linenumber",
                             "l_returnflag", "l_linestatus")
    frame, report = clean(rows)
    return quality_breakdown(profile(frame), report)


@query("Q14", """
    WITH n AS (SELECT o_custkey, nullif(o_orderstatus, 'F') AS o_orderstatus, o_totalprice * 2 AS o_totalprice,
                      CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority AS urgency FROM orders)
    SELECT 'o_custkey' AS "column", 'kept' AS change, 'bigint' AS old_type, 'bigint' AS new_type,
           0.0::DOUBLE AS missing_pct_shift, 0::BIGINT AS unique_shift, 0.0::DOUBLE AS mean_shift
    UNION ALL SELECT 'o_orderstatus', 'kept', 'string', 'string',
        (SELECT round((count(*) - count(o_orderstatus)) * 100.0 / count(*), 2) FROM n)::DOUBLE, -1, NULL
    UNION ALL SELECT 'o_totalprice', 'kept', 'double', 'double', 0.0, 0, (SELECT round(avg(o_totalprice), 4) FROM orders)
    UNION ALL SELECT 'o_orderkey', 'type_changed', 'bigint', 'string', 0.0, 0, NULL
    UNION ALL SELECT 'o_orderpriority', 'removed', 'string', NULL, NULL, NULL, NULL
    UNION ALL SELECT 'urgency', 'added', NULL, 'string', NULL, NULL, NULL""")
def drift_between_versions(t):
    old = t.orders.drop("o_orderdate")
    new = old.select("o_custkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"),
                     (F.col("o_totalprice") * 2).alias("o_totalprice"),
                     F.col("o_orderkey").cast("string").alias("o_orderkey"),
                     F.col("o_orderpriority").alias("urgency"))
    return drift(old, new)


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("Q3, Q4, Q16", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing,
        count(DISTINCT {c}) AS unique_count FROM orders""" for c in _ORDER_COLUMNS))
def distinct_counts_by_sketch(t):
    """Counts of a kept profile: one scan, distinct values from theta sketches (exact here)."""
    return sketches.kept_profile(t.orders).select("column", "rows", "missing", "unique_count")


def _two_versions(t):
    old = t.orders.drop("o_orderdate")
    new = old.select("o_custkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"),
                     (F.col("o_totalprice") * 2).alias("o_totalprice"),
                     F.col("o_orderkey").cast("string").alias("o_orderkey"),
                     F.col("o_orderpriority").alias("urgency"))
    return old, new


@query("Q14", QUERIES["drift_between_versions"].sql)
def drift_from_kept_profiles(t):
    """Drift read from two kept profiles of the versions; neither table is read by the drift."""
    old, new = _two_versions(t)
    folder = new_folder(old.sparkSession)
    for version in (old, new):
        sketches.save_profile(sketches.kept_profile(version), folder)
    spark = old.sparkSession
    found = sketches.drift(sketches.read_profile(spark, folder, 1), sketches.read_profile(spark, folder, 2))
    return found.drop("distance")
