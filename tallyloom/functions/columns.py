"""Schema checks and number clean-up."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, _NUMBERS)


def is_time(data_type: T.DataType) -> bool:
    return isinstance(data_type, _TIMES)


def number_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_number(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_time(f.dataType)]


def ref(name: str) -> Column:
    """The column of exactly this name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(f"The table has no column '{name}'.")


def require_number(df: DataFrame, name: str, what: str) -> None:
    require(df, name)
    if not is_number(df.schema[name].dataType):
        raise ValueError(f"{what} needs a column of numbers, '{name}' is none.")


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN in floating columns becomes NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.nanvl(ref(c), F.lit(None)) for c in floats}) if floats else df


def clean_number(value: Column, places: int = 4) -> Column:
    """The number rounded; missing, NaN and infinite read as 0."""
    number = value.cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return F.round(F.when(usable, number).otherwise(F.lit(0.0)), places)


def as_number(df: DataFrame, name: str) -> Column:
    """The column as double, text that is no number as NULL."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return ref(name).try_cast("double")
    return ref(name).cast("double")
