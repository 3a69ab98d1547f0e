"""Tables from and to files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tallyloom.functions.columns import nan_to_null

FORMATS = ("csv", "parquet", "json")


def _format_of(path: str, table_format: str | None) -> str:
    name = table_format or path.rstrip("/").rsplit(".", 1)[-1]
    if name.lower() not in FORMATS:
        raise ValueError(f"Unsupported format '{name}'; use one of {', '.join(FORMATS)}.")
    return name.lower()


def read_table(
    spark: SparkSession,
    path: str | list[str],
    table_format: str | None = None,
    schema: StructType | str | None = None,
    allow_empty: bool = False,
) -> DataFrame:
    """Read one path, or several as one table. Without ``schema`` the types of CSV and JSON are
    inferred, which costs a pass over the input; give one for large inputs. Files are split
    across tasks by ``spark.sql.files.maxPartitionBytes``. NaN becomes NULL."""
    paths = [path] if isinstance(path, str) else list(path)
    kinds = {_format_of(p, table_format) for p in paths}
    if len(kinds) != 1:
        raise ValueError("All paths must hold the same format.")
    kind = kinds.pop()
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", False)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.option("inferSchema", True)
    df = nan_to_null(reader.load(paths))
    if not allow_empty and df.isEmpty():
        raise ValueError("The table has no rows.")
    return df


def union_tables(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of several tables with the same columns, duplicates kept."""
    for other in others:
        first = first.unionByName(other)
    return first


def write_table(df: DataFrame, path: str, table_format: str = "csv") -> None:
    """Write a directory of part files, one per task; CSV gets a header."""
    kind = _format_of(path, table_format)
    writer = df.write.mode("overwrite").format(kind)
    (writer.option("header", True).option("escape", '"') if kind == "csv" else writer).save(path)
