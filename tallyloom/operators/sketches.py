"""Profiles kept as mergeable sketches, and drift read from two kept profiles.

``kept_profile`` scans a table once and keeps, per column, its counts and moments beside two
binary sketches: a theta sketch of its distinct values (exact while a column has at most
2**``LG_ENTRIES`` distinct values, beyond that a relative standard error of about
2**(-``LG_ENTRIES``/2)) and, for numbers, a KLL quantile sketch (rank error about 1.65 % at
``KLL_K`` = 200). Both are aggregates with partial merges in the map tasks: no value is shuffled,
and sketches of parts of a table merge into the sketch of the whole.

Kept profiles are Parquet tables, one folder per table, one ``version=N`` part per save. ``drift``
reads two of them and nothing of either table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tallyloom.functions.columns import is_number, ref
from tallyloom.operators.cleaning import per_column

LG_ENTRIES = 16
KLL_K = 200
#: ranks at which two quantile functions are compared
PROBES = [i / 100 for i in range(1, 100)]


def kept_profile(df: DataFrame) -> DataFrame:
    """One row per column: column, position, type, rows, missing, missing_pct, unique_count, mean,
    min, max, distinct (theta sketch), quantiles (KLL sketch, numbers only)."""
    facts = {}
    for position, field in enumerate(df.schema):
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            continue
        value = ref(field.name)
        number = is_number(field.dataType)
        nothing = F.lit(None).cast("double")
        facts[field.name] = {
            "position": F.lit(position),
            "type": F.lit(field.dataType.simpleString()),
            "rows": F.count(F.lit(1)),
            "missing": F.count_if(value.isNull()),
            # values as text, so that a column whose type changes keeps its distinct values
            "distinct": F.theta_sketch_agg(value.cast("string"), LG_ENTRIES),
            "mean": F.avg(value.cast("double")) if number else nothing,
            "min": F.min(value.cast("double")) if number else nothing,
            "max": F.max(value.cast("double")) if number else nothing,
            "quantiles": (F.kll_sketch_agg_double(value.cast("double"), KLL_K) if number
                          else F.lit(None).cast("binary")),
        }
    found = per_column(df, facts)
    return found.select(
        "column", "position", "type", "rows", "missing",
        F.coalesce(F.round(F.try_divide(F.col("missing") * 100.0, F.col("rows")), 2), F.lit(0.0)).alias("missing_pct"),
        F.theta_sketch_estimate("distinct").alias("unique_count"), "mean", "min", "max", "distinct", "quantiles")


def save_profile(profile: DataFrame, folder: str) -> int:
    """Append ``profile`` to the kept profiles in ``folder`` as the next version; returns it."""
    spark = profile.sparkSession
    version = (_latest(spark, folder) or 0) + 1
    profile.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(folder)
    return version


def _latest(spark: SparkSession, folder: str) -> int | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(folder).agg(F.max("version")).first()[0]


def read_profile(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A kept profile; the latest version unless one is named."""
    version = version or _latest(spark, folder)
    return spark.read.parquet(folder).filter(F.col("version") == version).drop("version")


def _distance(old: Column, new: Column, low: Column, high: Column) -> Column:
    """Largest shift of the quantile function over ``PROBES``, as a share of the old range
    [low, high]; the sketches are read at literal ranks."""
    shifts = [F.abs(F.kll_sketch_get_quantile_double(new, F.lit(p)) - F.kll_sketch_get_quantile_double(old, F.lit(p)))
              for p in PROBES]
    spread = high - low
    return F.when(old.isNotNull() & new.isNotNull() & (spread > 0), F.greatest(*shifts) / spread)


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two kept profiles, one row per column: (column, change, old_type,
    new_type, missing_pct_shift, unique_shift, mean_shift, distance). ``distance`` is the largest
    shift of the numbers' quantile function at the ranks of ``PROBES`` (within the KLL rank
    error: KLL compaction is random, so on a column of few values a probe may read the next value
    even between equal tables), as a share of the old column's range; NULL where a side has no
    numbers or the old column is constant."""
    sides = [
        p.select("column", F.col("type").alias(f"{s}_type"), F.col("missing_pct").alias(f"{s}_missing"),
                 F.col("unique_count").alias(f"{s}_unique"), F.col("mean").alias(f"{s}_mean"),
                 F.col("quantiles").alias(f"{s}_quantiles"), F.col("min").alias(f"{s}_min"),
                 F.col("max").alias(f"{s}_max"))
        for s, p in (("old", old), ("new", new))]
    both = sides[0].join(sides[1], "column", "full")
    change = (
        F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "type_changed").otherwise("kept"))
    return both.select(
        "column", change.alias("change"), "old_type", "new_type",
        F.round(F.col("new_missing") - F.col("old_missing"), 2).alias("missing_pct_shift"),
        (F.col("new_unique") - F.col("old_unique")).alias("unique_shift"),
        F.round(F.col("new_mean") - F.col("old_mean"), 4).alias("mean_shift"),
        _distance(F.col("old_quantiles"), F.col("new_quantiles"), F.col("old_min"), F.col("old_max")).alias("distance"))
