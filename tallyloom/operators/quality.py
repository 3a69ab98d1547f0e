"""Correlation, quality scores and drift between versions of a table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import as_number, number_columns
from tallyloom.operators.profiling import column_facts, distinct_values, is_identifier_name


#: Columns per tile of the cross moments; a task holds six tiles' products at a time.
TILE = 64


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, r) for all pairs, over the rows where both have a value (NaN counts as
    missing). A constant column correlates with nothing: 0.

    Cross moments in tiles: each task reads its rows in Arrow batches and, for every pair of
    column tiles, adds the masked sums of a pair - rows with both, their sums, sums of squares and
    products - as six matrix products of values (missing as 0, shifted by the column's least value
    against cancellation) and presence masks. A task holds its sums for all pairs, O(columns²), and
    one batch; nothing grows with the rows. The sums meet in one aggregate by pair."""
    if columns is None:
        columns = [c for c in number_columns(df) if not is_identifier_name(c)]
    if not columns:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    numbers = df.select(*[as_number(df, c).alias(f"_c{i}") for i, c in enumerate(columns)])
    shift = [v if v is not None else 0.0 for v in numbers.agg(*[F.min(c) for c in numbers.columns]).first()]
    count = len(columns)
    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((len(sums), count, count))
        base = np.array(shift)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(count)])
            m = ~np.isnan(x)
            x0 = np.where(m, x - base, 0.0)
            mf, q = m.astype(float), x0 * x0
            for i in range(0, count, TILE):
                a = slice(i, i + TILE)
                for j in range(i, count, TILE):
                    b = slice(j, j + TILE)
                    total[0, a, b] += mf[:, a].T @ mf[:, b]
                    total[1, a, b] += x0[:, a].T @ mf[:, b]
                    total[2, a, b] += mf[:, a].T @ x0[:, b]
                    total[3, a, b] += q[:, a].T @ mf[:, b]
                    total[4, a, b] += mf[:, a].T @ q[:, b]
                    total[5, a, b] += x0[:, a].T @ x0[:, b]
        first, second = np.triu_indices(count)
        columns_out = {"a": first.astype(np.int32), "b": second.astype(np.int32)}
        columns_out |= {name: total[k][first, second] for k, name in enumerate(sums)}
        yield pa.RecordBatch.from_pydict(columns_out)

    schema = "a int, b int, " + ", ".join(f"{s} double" for s in sums)
    merged = numbers.mapInArrow(run, schema).groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in sums])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread_x = n * F.col("sxx") - sx * sx
    spread_y = n * F.col("syy") - sy * sy
    # a spread within rounding of zero is a constant
    flat = (spread_x <= F.lit(1e-12) * n * F.col("sxx")) | (spread_y <= F.lit(1e-12) * n * F.col("syy"))
    r = (n * F.col("sxy") - sx * sy) / F.sqrt(spread_x * spread_y)
    r = F.when(~flat & (n > 0), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))  # greatest skips nulls
    r = F.round(F.coalesce(r, F.lit(0.0)), 2)
    names = F.array(*[F.lit(c) for c in columns])
    pairs = merged.select(F.explode(F.array(
        F.struct(names[F.col("a")].alias("col_a"), names[F.col("b")].alias("col_b"), r.alias("r")),
        F.struct(names[F.col("b")].alias("col_a"), names[F.col("a")].alias("col_b"), r.alias("r")))).alias("p"))
    return pairs.select("p.*").dropDuplicates(["col_a", "col_b"])


def correlation_matrix_by_expressions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, r) for all pairs, over the rows where both have a value, from one
    aggregate of six expressions per pair: for few columns, and to test the tiled way."""
    if columns is None:
        columns = [c for c in number_columns(df) if not is_identifier_name(c)]
    values = {c: as_number(df, c) for c in columns}
    rows = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            x = F.when(values[b].isNotNull(), values[a])
            y = F.when(values[a].isNotNull(), values[b])
            spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
            both = F.try_divide(F.covar_pop(x, y), spread)
            r = F.round(F.coalesce(both, F.lit(0.0)), 2)
            for first, second in {(a, b), (b, a)}:
                rows.append(F.struct(F.lit(first).alias("col_a"), F.lit(second).alias("col_b"),
                                     r.alias("r")))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def quality_score(profiled: DataFrame) -> DataFrame:
    """100 minus the mean share of missing values, from a profile or from ``column_facts``."""
    return profiled.agg(F.round(100 - F.avg("missing_pct"), 1).alias("quality_score"))


def quality_breakdown(profiled: DataFrame, report: DataFrame) -> DataFrame:
    """(completeness, consistency, type_confidence) from the profile and the cleaning report."""
    treated = report.filter(
        (F.col("step") == "outliers") & (F.col("action") != "none") & (F.col("count") > 0)
    ).agg(F.count(F.lit(1))).scalar()
    numbers = F.greatest(F.count_if(F.col("kpi_confidence").isNotNull()
                                    & (F.col("semantic_role") != "identifier")), F.lit(1))
    confidence = F.coalesce("kpi_confidence", "geo_confidence",
                            F.when(F.col("semantic_role") == "date", 1.0).otherwise(0.0))
    consistency = 100 * (1 - treated / numbers)
    return profiled.agg(
        F.round(F.greatest(100 - F.avg("missing_pct"), F.lit(0.0)), 1).alias("completeness"),
        F.round(F.greatest(consistency, F.lit(0.0)), 1).alias("consistency"),
        F.round(F.avg(confidence) * 100, 1).alias("type_confidence"),
    )


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two versions of a table, one row per column: (column, change,
    old_type, new_type, missing_pct_shift, unique_shift, mean_shift)."""
    sides = []
    for side, df in (("old", old), ("new", new)):
        facts = column_facts(df).join(
            F.broadcast(distinct_values(df).select("column", "unique_count")), "column", "left")
        sides.append(facts.select(
            "column", F.col("type").alias(f"{side}_type"),
            F.col("missing_pct").alias(f"{side}_missing"),
            F.coalesce("unique_count", F.lit(0)).alias(f"{side}_unique"),
            F.col("mean").alias(f"{side}_mean")))
    both = sides[0].join(sides[1], "column", "full")
    change = (
        F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "type_changed").otherwise("kept")
    )
    return both.select(
        "column", change.alias("change"), "old_type", "new_type",
        F.round(F.col("new_missing") - F.col("old_missing"), 2).alias("missing_pct_shift"),
        (F.col("new_unique") - F.col("old_unique")).alias("unique_shift"),
        F.round(F.col("new_mean") - F.col("old_mean"), 4).alias("mean_shift"),
    )
