"""Automatic cleaning of a whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.columns import number_columns, ref, text_columns
from tallyloom.functions.fixed import ORDER_CORRELATION
from tallyloom.operators.cleaning import (
    apply_spellings, changed_spellings, clip_to_percentiles, date_columns, drop_duplicate_rows,
    medians, missing_report, most_frequent, outlier_counts, spelling_report, spellings, value_counts,
)
from tallyloom.operators.ordered import forward_fill, order_correlation
from tallyloom.operators.profiling import is_identifier_name
from tallyloom.operators.staging import stage

REPORT = "column string, step string, action string, count bigint, before string, after string"
_SCALAR = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def clean(
    df: DataFrame,
    treat_outliers: bool = True,
    synonyms: dict[str, str] | None = None,
    order_by: list[str] | None = None,
    exclude_outliers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Remove duplicates, fill gaps, unify category spelling and clip outliers: the cleaned table
    and a report (column, step, action, count, before, after).

    With ``order_by`` (ending in a unique column) and a date column, number columns that follow
    the row order are filled forward, others with the median. Identifiers are not clipped unless
    ``exclude_outliers`` says otherwise. What reaches the driver is a few facts per column."""
    facts: list[tuple] = []

    def note(column, step, action, count, before=None, after=None):
        facts.append((column, step, action, int(count), before, after))

    distinct = stage(drop_duplicate_rows(df))
    before, after = df.count(), distinct.count()
    note(None, "rows", "initial", before)
    note(None, "rows", "cleaned", after)
    note(None, "duplicates", "removed", before - after)

    missing = {r["column"]: r for r in missing_report(distinct).collect()}
    numbers = [c for c in number_columns(distinct) if c in missing]
    forward: list[str] = []
    if numbers and order_by and not date_columns(distinct).filter("is_date").isEmpty():
        related = order_correlation(distinct, numbers, order_by).collect()
        forward = [r["column"] for r in related if abs(r["spearman"] or 0) > ORDER_CORRELATION]
    by_median = [c for c in numbers if c not in forward]
    filled = forward_fill(distinct, forward, order_by) if forward else distinct
    if by_median:
        found = {r["column"]: r["median"] for r in
                 medians(distinct, by_median).collect()}
        filled = filled.withColumns({
            c: F.coalesce(ref(c).cast("double"), F.lit(found[c]).cast("double"))
            for c in by_median})

    texts = text_columns(distinct)
    by_mode = [c for c, r in missing.items() if r["strategy"] == "mode"
               and isinstance(distinct.schema[c].dataType, _SCALAR)]
    counted = list(dict.fromkeys(texts + by_mode))
    modes: dict[str, str] = {}
    counts = None
    if counted:
        counts = stage(value_counts(distinct, counted))
    if by_mode:
        modes = {r["column"]: r["value"] for r in
                 most_frequent(counts.filter(F.col("column").isin(by_mode))).collect()}
        filled = filled.withColumns({
            c: F.coalesce(ref(c), F.lit(v).cast(distinct.schema[c].dataType))
            for c, v in modes.items()})
    for name, row in missing.items():
        action = "forward_fill" if name in forward else row["strategy"]
        if action == "mode" and name not in modes:
            action = "left_as_is"
        note(name, "missing", action, row["missing"])

    if texts:
        # filled gaps count as occurrences of the value they were filled with
        extra = F.lit(0)
        for name, value in modes.items():
            here = (F.col("column") == name) & (F.col("value") == value)
            extra = F.when(here, F.lit(missing[name]["missing"])).otherwise(extra)
        with_fills = counts.withColumn("n", F.col("n") + extra)
        changed = changed_spellings(
            spellings(with_fills.filter(F.col("column").isin(texts)), synonyms))
        for row in spelling_report(changed).collect():
            note(row["column"], "categories", "normalized", row["values_normalized"])
            for example in row["examples"]:
                old, new = example.split(" -> ", 1)
                note(row["column"], "example", "normalized", 1, old, new)
        filled = apply_spellings(filled, changed)

    if forward:
        filled = stage(filled)
    if exclude_outliers is None:
        exclude_outliers = [c for c in df.columns if is_identifier_name(c)]
    checked = [c for c in number_columns(filled) if c not in exclude_outliers]
    if checked:
        outliers = {r["column"]: r["outliers"] for r in outlier_counts(filled, checked).collect()}
        clip = [c for c in checked if treat_outliers and outliers[c]]
        for name in checked:
            note(name, "outliers", "winsorized_1_99" if name in clip else "none", outliers[name])
        filled = clip_to_percentiles(filled, clip)
    return filled, df.sparkSession.createDataFrame(facts, REPORT)
