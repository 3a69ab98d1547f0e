"""Reading dates from text, period starts and period labels.

Periods are cut on the DATE value and cast back, so a TIMESTAMP_NTZ column stays one and no
session time zone takes part.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.columns import is_time, ref
from tallyloom.functions.fixed import DATE_FORMATS

GRAINS = ("quarter", "month", "week")


def parse_date_text(text: Column) -> Column:
    """The date a text stands for, else NULL. The shape is tested first, so that text which is
    no date at all never reaches a parser."""
    value = F.trim(text)
    parsed = F.lit(None).cast("timestamp_ntz")
    for shape, pattern in reversed(DATE_FORMATS):
        read = (
            value.try_cast("timestamp_ntz")
            if pattern is None
            else F.try_to_timestamp(value, F.lit(pattern)).cast("timestamp_ntz")
        )
        parsed = F.when(value.rlike(shape), read).otherwise(parsed)
    return parsed


def as_time(df: DataFrame, name: str) -> Column:
    """The column as a point in time; text is parsed, anything else is refused."""
    data_type = df.schema[name].dataType
    if is_time(data_type):
        return ref(name)
    if isinstance(data_type, T.StringType):
        return parse_date_text(ref(name))
    raise ValueError(f"Column '{name}' holds no dates.")


def time_type(df: DataFrame, name: str) -> str:
    data_type = df.schema[name].dataType
    return data_type.simpleString() if is_time(data_type) else "timestamp_ntz"


def period_start(moment: Column, grain: str, data_type: str) -> Column:
    return F.trunc(moment.cast("date"), grain).cast(data_type)


def period_label(start: Column, grain: Column) -> Column:
    """2024Q2, 2024-05 or 2024-04-29/2024-05-05."""
    day = start.cast("date")
    return (
        F.when(grain == "quarter",
               F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")))
        .when(grain == "month", F.substring(day.cast("string"), 1, 7))
        .otherwise(F.concat(day.cast("string"), F.lit("/"), F.date_add(day, 6).cast("string")))
    )
