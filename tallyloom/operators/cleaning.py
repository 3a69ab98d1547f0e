"""Duplicates, gaps, category spelling and outliers.

Facts about all columns come from one aggregate per step, never from one job per column."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.columns import as_number, number_columns, ref, require, text_columns
from tallyloom.functions.columns import time_columns
from tallyloom.functions.dates import parse_date_text
from tallyloom.functions.fixed import (
    COUNTRY_NAME_WORDS, COUNTRY_SYNONYMS, DATE_NAME_WORDS, DATE_SHARE, DATE_SHARE_WITH_NAME,
    MISSING_SHARE_LEFT_ALONE, OUTLIER_Z, SYNONYM_SHARE, WINSOR_HIGH, WINSOR_LOW,
)
from tallyloom.operators.ordered import column_percentiles
from tallyloom.operators.staging import lookup, stage

BLANKS = " \t\n\r\f\x0b"


def per_column(df: DataFrame, facts: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate over the whole table, turned into one row per column."""
    rows = [
        F.struct(F.lit(name).alias("column"), *[e.alias(k) for k, e in exprs.items()])
        for name, exprs in facts.items()
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Each distinct row once; gaps equal gaps. Copies meet in the map tasks first."""
    return df.dropDuplicates()


def duplicate_report(df: DataFrame) -> DataFrame:
    copies = df.groupBy(*[ref(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
    ).withColumn("duplicates_removed", F.col("rows_before") - F.col("rows_after"))


def date_facts(df: DataFrame) -> dict[str, dict[str, Column]]:
    """Aggregates that tell date columns: those of a time type, and text of which 80 % reads as a
    date, or 50 % when the name speaks of time. All rows count, not a sample."""
    facts = {}
    for name in time_columns(df):
        facts[name] = {"parsed_share": F.lit(1.0), "is_date": F.count(F.lit(1)) >= 0}
    for name in text_columns(df):
        hits = F.count_if(parse_date_text(ref(name)).isNotNull())
        share = F.coalesce(F.try_divide(hits.cast("double"), F.count(ref(name))), F.lit(0.0))
        named = any(word in name.lower() for word in DATE_NAME_WORDS)
        needed = DATE_SHARE_WITH_NAME if named else DATE_SHARE
        facts[name] = {"parsed_share": share, "is_date": share >= needed}
    return facts


def date_columns(df: DataFrame) -> DataFrame:
    """(column, parsed_share, is_date) of the time and text columns."""
    facts = date_facts(df)
    if not facts:
        return df.sparkSession.createDataFrame(
            [], "column string, parsed_share double, is_date boolean")
    return per_column(df, facts)


def missing_report(df: DataFrame) -> DataFrame:
    """(column, missing, missing_share, strategy) for the columns with gaps: numbers get the
    median, other columns the most frequent value, or are left alone above 40 % missing."""
    numbers = set(number_columns(df))
    facts = {}
    for name in df.columns:
        missing = F.count_if(ref(name).isNull())
        share = F.coalesce(F.try_divide(missing.cast("double"), F.count(F.lit(1))), F.lit(0.0))
        strategy = F.lit("median") if name in numbers else F.when(
            share > MISSING_SHARE_LEFT_ALONE, F.lit("skipped_high_missing")
        ).otherwise(F.lit("mode"))
        facts[name] = {"missing": missing, "missing_share": share, "strategy": strategy}
    return per_column(df, facts).filter(F.col("missing") > 0)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per distinct value of several columns: (column, value as text, n)."""
    texts = df.select(*[ref(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([], [ref(c) for c in columns], "column", "value")
    return long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame) -> DataFrame:
    """(column, value) of the most frequent value, the smallest on ties. Works on counts, so no
    task holds all values of a column."""
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), "value")).alias("value")
    )


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    found = column_percentiles(df, columns, [0.5])
    return found.select("column", F.get("quantiles", F.lit(0)).alias("median"))


def fill_with_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Gaps in number columns become the median, one pass for all columns. At most one row per
    column reaches the driver."""
    require(df, *columns)
    found = {r["column"]: r["median"] for r in medians(df, columns).collect()}
    return df.withColumns({
        c: F.coalesce(ref(c).cast("double"), F.lit(found[c]).cast("double")) for c in columns
    })


def fill_with_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Gaps become the most frequent value, one pass for all columns."""
    require(df, *columns)
    found = {r["column"]: r["value"] for r in most_frequent(value_counts(df, columns)).collect()}
    return df.withColumns({
        c: F.coalesce(ref(c), F.lit(found.get(c)).cast(df.schema[c].dataType)) for c in columns
    })


def synonym_text(value: Column, synonyms: dict[str, str]) -> Column:
    """The value's synonym, looked up without regard to case, or the value itself."""
    if not synonyms:
        return value
    table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(value)), value)


def spellings(counts: DataFrame, synonyms: dict[str, str] | None = None) -> DataFrame:
    """What each counted value becomes: (column, value, n, final). Blanks around it go, letters
    take the case seen most often, and country-like columns take the synonyms: their name says
    so, or 30 % of their distinct values are in the synonym table."""
    synonyms = COUNTRY_SYNONYMS if synonyms is None else synonyms
    synonyms = {k.lower(): v for k, v in synonyms.items()}
    trimmed = counts.withColumn("trimmed", F.btrim("value", F.lit(BLANKS)))
    by_trimmed = trimmed.groupBy("column", "trimmed").agg(F.sum("n").alias("seen"))
    canonical = by_trimmed.groupBy("column", F.lower("trimmed").alias("folded")).agg(
        F.min_by("trimmed", F.struct(-F.col("seen"), "trimmed")).alias("usual")
    )
    in_table = F.col("folded").isin(*synonyms) if synonyms else F.lit(False)
    named = F.lit(False)
    for word in COUNTRY_NAME_WORDS:
        named = named | F.contains(F.lower("column"), F.lit(word))
    share = F.count_if(in_table) / F.count(F.lit(1))
    like_country = canonical.groupBy("column").agg(
        (F.first(named) | (share >= SYNONYM_SHARE)).alias("like_country")
    )
    final = F.when(F.col("like_country"), synonym_text(F.col("usual"), synonyms)).otherwise(
        F.col("usual")
    )
    decided = canonical.join(F.broadcast(like_country), "column").select(
        "column", "folded", final.alias("final")
    )
    values = trimmed.withColumn("folded", F.lower("trimmed"))
    return values.join(decided, ["column", "folded"]).select("column", "value", "n", "final")


def spelling_report(spelled: DataFrame, examples: int = 5) -> DataFrame:
    """(column, values_normalized, examples): changed rows, and the first changed spellings in
    alphabetical order. Each task keeps its own few examples per column first."""
    changed = spelled.filter(F.col("value") != F.col("final"))
    totals = changed.groupBy("column").agg(F.sum("n").alias("values_normalized"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    few = changed.withColumn("place", place).filter(F.col("place") <= examples)
    pairs = F.struct("place", F.col("value").alias("before"), F.col("final").alias("after"))
    listed = few.groupBy("column").agg(F.sort_array(F.collect_list(pairs)).alias("pairs"))
    shown = F.transform("pairs", lambda p: F.concat(p["before"], F.lit(" -> "), p["after"]))
    return totals.join(listed, "column").select(
        "column", "values_normalized", shown.alias("examples")
    )


def changed_spellings(spelled: DataFrame) -> DataFrame:
    """The values that change, kept for the report and the replacement."""
    return stage(spelled.filter(F.col("value") != F.col("final")))


def apply_spellings(df: DataFrame, changed: DataFrame) -> DataFrame:
    """Replace changed values. Only values that change are looked up, and only in the columns
    that have some."""
    out = df
    for name in [r["column"] for r in changed.select("column").distinct().collect()]:
        table = changed.filter(F.col("column") == name).select(
            F.col("value").alias("_value"), F.col("final").alias("_final"))
        found = lookup(out, table, ref(name), "_value")
        out = found.withColumn(name, F.coalesce("_final", ref(name))).drop("_final")
    return out


def normalize_categories(df: DataFrame, columns: list[str] | None = None,
                         synonyms: dict[str, str] | None = None) -> DataFrame:
    """One spelling per category in the text columns."""
    columns = text_columns(df) if columns is None else columns
    require(df, *columns)
    if not columns:
        return df
    spelled = spellings(value_counts(df, columns), synonyms)
    return apply_spellings(df, changed_spellings(spelled))


def outlier_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, mean, std, outliers): values more than three sample deviations off the mean."""
    columns = number_columns(df) if columns is None else columns
    require(df, *columns)
    numbers = {c: as_number(df, c) for c in columns}
    stats = df.agg(F.struct(*[
        F.struct(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")).alias(f"c{i}")
        for i, v in enumerate(numbers.values())
    ]).alias("s")).scalar()
    facts = {}
    for i, (name, value) in enumerate(numbers.items()):
        mean, std = stats[f"c{i}"]["mean"], stats[f"c{i}"]["std"]
        far = (std > 0) & (F.abs((value - mean) / F.nullif(std, F.lit(0.0))) > OUTLIER_Z)
        facts[name] = {"mean": mean, "std": std, "outliers": F.count_if(far)}
    return per_column(df, facts)


def winsorize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Clip columns that have outliers to their 1st and 99th percentile."""
    columns = number_columns(df) if columns is None else columns
    found = outlier_counts(df, columns).filter(F.col("outliers") > 0).select("column").collect()
    return clip_to_percentiles(df, [r["column"] for r in found])


def clip_to_percentiles(df: DataFrame, columns: list[str]) -> DataFrame:
    if not columns:
        return df
    bounds = {
        r["column"]: r["quantiles"]
        for r in column_percentiles(df, columns, [WINSOR_LOW, WINSOR_HIGH]).collect()
    }

    def clipped(name):
        low, high = (F.lit(b) for b in bounds[name])
        value = ref(name).cast("double")
        return F.when(value < low, low).when(value > high, high).otherwise(value)

    return df.withColumns({c: clipped(c) for c in columns})


def cleaning_summary(report: DataFrame) -> DataFrame:
    """Sentences on what cleaning did: (section, column, sentence), from the report and its row
    counts."""
    rows = report.filter((F.col("step") == "rows") & (F.col("action") == "cleaned")).agg(
        F.max("count")).scalar()
    count = F.col("count").cast("string")
    percent = F.round(F.try_divide(F.col("count") * 100.0, rows), 1).cast("string")
    how = (F.when(F.col("action") == "forward_fill", "forward-filled")
           .otherwise(F.concat("action", F.lit("-imputed"))))
    left_alone = F.concat("column", F.lit(": "), percent,
                          F.lit("% missing — left as-is, flagged for review"))
    sentence = (
        F.when(F.col("step") == "rows", F.concat(F.lit("Rows "), "action", F.lit(": "), count))
        .when(F.col("step") == "duplicates", F.concat(F.lit("Duplicates removed: "), count))
        .when(F.col("action") == "skipped_high_missing", left_alone)
        .when(F.col("step") == "missing",
              F.concat("column", F.lit(": "), how, F.lit(" ("), count, F.lit(" missing values)")))
        .when((F.col("step") == "outliers") & (F.col("action") != "none"),
              F.concat("column", F.lit(": "), count,
                       F.lit(" outliers capped at 1st/99th percentile")))
        .when(F.col("step") == "categories",
              F.concat("column", F.lit(": "), count, F.lit(" values normalized")))
    )
    said = report.select(F.col("step").alias("section"), "column", sentence.alias("sentence"))
    return said.filter(F.col("sentence").isNotNull())
