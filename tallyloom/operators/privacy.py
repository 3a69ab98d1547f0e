"""Finding and masking personal data."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import ref, require, text_columns
from tallyloom.functions.fixed import (
    PII_MASK_CONFIDENCE, PII_NAME_PATTERNS, PII_TYPE_ORDER, PII_VALUE_PATTERNS,
)
from tallyloom.operators.cleaning import per_column


def personal_data(df: DataFrame) -> DataFrame:
    """(column, reason, confidence, kind) of columns whose name or values look like personal
    data. All values are tested, in one aggregate over all text columns and patterns."""
    texts = set(text_columns(df))
    facts = {}
    for name in df.columns:
        reasons, scores = [], [F.lit(0.0)]
        for pattern, kind, confidence in PII_NAME_PATTERNS:
            if re.search(pattern, name.lower()):
                reasons.append(F.lit(f"column name matches {kind} pattern"))
                scores.append(F.lit(confidence))
        if name in texts:
            values = F.count(ref(name))
            for pattern, kind, confidence in PII_VALUE_PATTERNS:
                hits = F.count_if(ref(name).rlike(pattern))
                share = F.coalesce(F.try_divide(hits.cast("double"), values), F.lit(0.0))
                scores.append(F.lit(confidence) * F.least(F.lit(1.0), share * 2))
                said = F.concat(hits.cast("string"), F.lit("/"), values.cast("string"),
                                F.lit(f" values match {kind} format"))
                reasons.append(F.when(hits > 0, said))
        if not reasons:
            continue
        facts[name] = {
            "reason": F.concat_ws("; ", *reasons),
            "confidence": F.round(F.greatest(*scores, F.lit(0.0)), 2),
        }
    if not facts:
        return df.sparkSession.createDataFrame(
            [], "column string, reason string, confidence double, kind string")
    found = per_column(df, facts).filter(F.col("reason") != "")
    kind = F.lit("unknown")
    for name in reversed(PII_TYPE_ORDER):
        kind = F.when(F.contains(F.lower("reason"), F.lit(name)), F.lit(name)).otherwise(kind)
    return found.withColumn("kind", kind)


def mask(value: Column, kind: str) -> Column:
    """The value with all but a harmless rest hidden."""
    parts = F.split(value, r"\.")
    last_four = F.right(value, F.lit(4))
    if kind == "email":
        halves = F.split(value, "@")
        ending = F.element_at(F.split(F.get(halves, F.lit(1)), r"\."), -1)
        shown = F.concat(F.substring(value, 1, 1), F.lit("***@***."), ending)
        return F.when(value.isNotNull(), F.when(
            (F.size(halves) == 2) & (F.length(F.get(halves, F.lit(0))) > 0), shown
        ).otherwise(F.lit("***@***.***")))
    if kind == "phone":
        digits = F.regexp_replace(value, r"\D", "")
        shown = F.concat(F.lit("***-***-"), F.right(digits, F.lit(4)))
        return F.when(F.length(digits) >= 4, shown).when(
            value.isNotNull(), F.lit("***-***-****"))
    if kind == "ssn":
        return F.when(F.length(value) >= 4, F.concat(F.lit("***-**-"), last_four)).when(
            value.isNotNull(), F.lit("***-**-****"))
    if kind == "credit_card":
        return F.when(F.length(value) >= 4, F.concat(F.lit("**** **** **** "), last_four)).when(
            value.isNotNull(), F.lit("**** **** **** ****"))
    if kind == "ip_address":
        shown = F.concat(F.lit("***.***.***."), F.element_at(parts, -1))
        return F.when(F.size(parts) == 4, shown).when(
            value.isNotNull(), F.lit("***.***.***.***"))
    return F.when(value.isNotNull(), F.concat(F.substring(value, 1, 1), F.lit("***")))


def mask_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Mask whole columns, given the kind of data in each."""
    require(df, *kinds)
    return df.withColumns({c: mask(ref(c).cast("string"), k) for c, k in kinds.items()})


def masked_preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """The first rows of the columns that hold personal data with enough confidence, masked."""
    found = personal_data(df).filter(F.col("confidence") >= PII_MASK_CONFIDENCE)
    kinds = {r["column"]: r["kind"] for r in found.select("column", "kind").collect()}
    first = df.orderBy(*[ref(c) for c in order_by]).limit(n)
    return mask_columns(first, kinds).select(*[ref(c) for c in kinds])
