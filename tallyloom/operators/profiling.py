"""What a table holds: one row of facts and roles per column."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.columns import is_number, number_columns, ref, text_columns
from tallyloom.functions.fixed import (
    CALENDAR_PART_PATTERN, DEMOGRAPHIC_WORDS, FINANCIAL_WORDS, GEO_WORDS, IDENTIFIER_NAMES,
    IDENTIFIER_PATTERN, KNOWN_COUNTRIES, KPI_WORDS, RATING_WORDS, TARGET_WORDS,
)
from tallyloom.operators.cleaning import date_facts, per_column, value_counts
from tallyloom.operators.ordered import column_percentiles

SAMPLES = 3
MEASURE_DISTINCT = 5


def is_identifier_name(name: str) -> bool:
    return bool(re.search(IDENTIFIER_PATTERN, name.lower())) or name.lower() in IDENTIFIER_NAMES


def _any_word(name: Column, words: list[str]) -> Column:
    return name.rlike("|".join(re.escape(w) for w in words))


def table_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns)).cast("bigint"))


def column_facts(df: DataFrame) -> DataFrame:
    """(column, position, type, missing_pct, mean, std, min, max, is_date), one scan for all
    columns."""
    facts = {}
    dates = date_facts(df)
    nothing = F.lit(None).cast("double")
    for position, field in enumerate(df.schema):
        value = ref(field.name)
        missing = F.count_if(value.isNull()) * 100.0
        row = {
            "position": F.lit(position),
            "type": F.lit(field.dataType.simpleString()),
            "missing_pct": F.coalesce(
                F.round(F.try_divide(missing, F.count(F.lit(1))), 2), F.lit(0.0)),
        }
        numbers = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
        for name, func in numbers.items():
            row[name] = (
                F.coalesce(func(value.cast("double")), F.lit(0.0))
                if is_number(field.dataType) else nothing
            )
        date = dates.get(field.name)
        row["is_date"] = date["is_date"] if date else F.lit(False)
        facts[field.name] = row
    return per_column(df, facts)


def distinct_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, unique_count, sample_values): exact counts, and the three smallest values as
    text. Values are counted once for all columns."""
    columns = columns or [f.name for f in df.schema
                          if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    pairs = value_counts(df, columns).select("column", "value")
    counts = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    first = pairs.withColumn("place", place).filter(F.col("place") <= SAMPLES)
    samples = first.groupBy("column").agg(
        F.sort_array(F.collect_list("value")).alias("sample_values"))
    return counts.join(F.broadcast(samples), "column")


def approx_distinct_values(df: DataFrame) -> DataFrame:
    """(column, unique_count) by sketch, in the same single scan style as ``column_facts``."""
    return per_column(df, {
        f.name: {"unique_count": F.approx_count_distinct(ref(f.name))} for f in df.schema
        if f.dataType.typeName() not in ("array", "map", "struct", "variant")})


def _role_columns(
    kpi_words: list[str], geo_words: list[str]
) -> dict[str, Column]:
    """Role, default aggregation and confidences from name, type, distinct count and samples."""
    name = F.lower("column")
    number, date = F.col("_number"), F.col("is_date")
    identifier = name.rlike(IDENTIFIER_PATTERN) | name.isin(IDENTIFIER_NAMES)
    calendar = name.rlike(CALENDAR_PART_PATTERN)
    # (condition, role, aggregation, confidence), the first that holds decides
    tiers = [
        (identifier, "identifier", "count", 0.0),
        (calendar, "temporal_discrete", "count", 0.0),
        (_any_word(name, FINANCIAL_WORDS), "kpi", "sum", 1.0),
        (_any_word(name, TARGET_WORDS), "kpi", "mean", 0.85),
        (_any_word(name, RATING_WORDS), "kpi", "mean", 0.75),
        (_any_word(name, DEMOGRAPHIC_WORDS), "measure", "mean", 0.35),
        (_any_word(name, kpi_words), "kpi", "sum", 0.6),
        (F.col("unique_count") > MEASURE_DISTINCT, "measure", "sum", 0.25),
        (F.lit(True), "measure", "count", 0.1),
    ]
    role, func, score = (F.lit(None).cast(t) for t in ("string", "string", "double"))
    for condition, r, f, s in reversed(tiers):
        role = F.when(condition, F.lit(r)).otherwise(role)
        func = F.when(condition, F.lit(f)).otherwise(func)
        score = F.when(condition, F.lit(s)).otherwise(score)
    place_name = _any_word(name, geo_words)
    place_value = F.col("_text") & F.coalesce(F.exists("sample_values", lambda v: (
        v.rlike("^[A-Z]{2,3}$") | F.lower(v).isin(KNOWN_COUNTRIES))), F.lit(False))
    geo = F.when(place_name, 1.0).when(place_value, 0.5).otherwise(0.0)
    return {
        "semantic_role": F.when(date, "date").when(number, role)
        .when(geo > 0, "geographical").otherwise("dimension"),
        "default_aggregation": F.when(~date & number, func),
        "kpi_confidence": F.when(~date & number, score),
        "geo_confidence": F.when(~date & ~number, geo),
    }


def profile(
    df: DataFrame,
    kpi_words: list[str] | None = None,
    geo_words: list[str] | None = None,
    medians: bool = True,
) -> DataFrame:
    """One row per column: position, column, type, missing_pct, unique_count, sample_values,
    mean, std, min, max, median, semantic_role, default_aggregation, kpi_confidence,
    geo_confidence. The parts are joined on the column name, one row per column each. Without
    ``medians`` their pass is left out. A very large table can be profiled from
    ``sample_rows(df, 200_000, key)``."""
    numbers, texts = number_columns(df), text_columns(df)
    found = column_facts(df)
    found = found.join(F.broadcast(distinct_values(df)), "column", "left")
    if numbers and medians:
        middle = column_percentiles(df, numbers, [0.5]).select(
            "column", F.coalesce(F.get("quantiles", F.lit(0)), F.lit(0.0)).alias("median"))
        found = found.join(F.broadcast(middle), "column", "left")
    else:
        found = found.withColumn("median", F.lit(None).cast("double"))
    found = found.withColumns({
        "unique_count": F.coalesce("unique_count", F.lit(0)),
        "_number": F.col("column").isin(numbers) if numbers else F.lit(False),
        "_text": F.col("column").isin(texts) if texts else F.lit(False),
    })
    roles = _role_columns([w.lower() for w in kpi_words or KPI_WORDS],
                          [w.lower() for w in geo_words or GEO_WORDS])
    return found.select(
        "position", "column", "type", "missing_pct", "unique_count", "sample_values", "mean",
        "std", "min", "max", "median", *[e.alias(k) for k, e in roles.items()])


def kpi_columns(profiled: DataFrame) -> DataFrame:
    """(rank, column, kpi_confidence): the columns that measure something, the surest first, in
    table order on ties. A table without any falls back to its other number columns."""
    place = F.row_number().over(Window.orderBy(F.desc("kpi_confidence"), "position")).cast("int")
    numbers = profiled.filter(F.col("kpi_confidence").isNotNull())
    some_sure = F.max(F.col("kpi_confidence") > 0).over(Window.partitionBy())
    other = ~F.col("some_sure") & (F.col("semantic_role") != "identifier")
    chosen = numbers.withColumn("some_sure", some_sure).filter(
        (F.col("kpi_confidence") > 0) | other)
    return chosen.select(place.alias("rank"), "column", "kpi_confidence")


def column_roles(profiled: DataFrame) -> dict[str, list[str]]:
    """Column names by use, for the caller that picks columns: numbers, dates, categories, kpis.
    One row per column reaches the driver."""
    rows = profiled.select(
        "position", "column", "semantic_role", "kpi_confidence").orderBy("position").collect()
    roles = {
        "numbers": [r["column"] for r in rows if r["kpi_confidence"] is not None
                    and r["semantic_role"] != "identifier"],
        "dates": [r["column"] for r in rows if r["semantic_role"] == "date"],
        "categories": [r["column"] for r in rows
                       if r["semantic_role"] in ("geographical", "dimension")],
    }
    kpis = sorted((r for r in rows if r["kpi_confidence"]), key=lambda r: -r["kpi_confidence"])
    roles["kpis"] = [r["column"] for r in kpis] or roles["numbers"]
    return roles
