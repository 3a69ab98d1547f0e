"""Work that follows row order - running totals, forward fill, ranks, exact percentiles -
without gathering an ordered group in one task.

Rows are cut into near-equal *blocks* of neighbours by split points that come from a small
hash sample of the order key. A block number is a plain expression of the row, so it is the same
whenever it is computed again, on any executor. One pass sums up each block, a table of at most
one row per block and open group carries the sums forward, and a second pass finishes each block
on its own. A key that holds a third of all rows is a third of the blocks.

Order keys must end with a column that is unique per row (or per row of the group).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.columns import as_number, ref, require
from tallyloom.operators.staging import stage

SAMPLE_PER_BLOCK = 20
#: Percentiles: the rank error of the sketch is at most 1 / ACCURACY of a group's values.
ACCURACY = 10_000


def _sorted_key(order: list[str]) -> Column:
    return F.struct(*[ref(c).alias(f"k{i}") for i, c in enumerate(order)])


def split_points(df: DataFrame, order: list[str], blocks: int) -> Column:
    """A sorted array of at most ``blocks - 1`` order keys, as a one-value subquery. The sample
    holds about 20 distinct keys per block, whatever the size of the table."""
    keys = df.select(_sorted_key(order).alias("key"))
    wanted = float(SAMPLE_PER_BLOCK * blocks)
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.least(F.lit(1.0), F.lit(wanted) / F.greatest(rows, F.lit(1)).cast("double"))
    near = keys.filter(F.xxhash64("key") / F.lit(2.0**64) + F.lit(0.5) <= share).distinct()
    ordered = near.agg(F.array_sort(F.collect_list("key")).alias("keys"))
    size = F.size("keys")
    picks = F.transform(
        F.sequence(F.lit(1), F.lit(blocks - 1)),
        lambda i: F.get("keys", F.floor(i * size / F.lit(blocks)).cast("int")),
    )
    return ordered.select(
        F.when(size > 0, F.filter(picks, lambda x: x.isNotNull())).alias("cuts")
    ).scalar()


def block_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_block(df: DataFrame, order: list[str], blocks: int | None = None) -> DataFrame:
    """Add ``_block``, the number of split points at or before the row: a binary search written
    as one small expression per halving. Each reads the same one-value subquery, so the split
    points are never copied into rows."""
    require(df, *order)
    blocks = blocks or block_count(df)
    cuts, key = split_points(df, order, blocks), _sorted_key(order)
    out = df.withColumn("_block", F.lit(0))
    for bit in reversed(range((blocks - 1).bit_length())):
        ahead = F.col("_block") + F.lit(1 << bit)
        passed = F.get(cuts, ahead - 1) <= key
        out = out.withColumn("_block", F.when(passed, ahead).otherwise(F.col("_block")))
    return out


def _attach(rows: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    """Join the carried values of open groups; at most one group per block is open, so the
    broadcast side never has more rows than twice the number of blocks."""
    keys = [*by, "_block"]
    renamed = carried
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"_c{i}")
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & ref(k).eqNullSafe(F.col(f"_c{i}"))
    joined = rows.join(F.broadcast(renamed), match, "left")
    return joined.drop(*[f"_c{i}" for i in range(len(keys))])


def _open_groups(per_block: DataFrame, by: list[str]) -> DataFrame:
    """Groups that reach over more than one block."""
    spread = per_block.withColumn("_reach", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return spread.filter(F.col("_reach") > 1).drop("_reach")


def forward_fill(
    df: DataFrame, columns: list[str], order_by: list[str], partition_by: list[str] | None = None
) -> DataFrame:
    """Fill gaps with the last known value before them; gaps at the start stay."""
    by = list(partition_by or [])
    require(df, *columns, *order_by, *by)
    rows = with_block(df, [*by, *order_by])
    place = _sorted_key(order_by)
    last_known = [
        F.max_by(ref(c), F.when(ref(c).isNotNull(), place)).alias(f"_last{i}")
        for i, c in enumerate(columns)
    ]
    per_block = _open_groups(rows.groupBy(*[ref(b) for b in by], "_block").agg(*last_known), by)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(*[ref(b) for b in by], "_block", *[
        F.last(f"_last{i}", ignorenulls=True).over(before).alias(f"_carry{i}")
        for i in range(len(columns))
    ])
    up_to_here = (
        Window.partitionBy(*[ref(b) for b in by], "_block")
        .orderBy(*[ref(c) for c in order_by])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = _attach(rows, carried, by)
    filled = {
        c: F.coalesce(F.last(ref(c), ignorenulls=True).over(up_to_here), F.col(f"_carry{i}"))
        for i, c in enumerate(columns)
    }
    return joined.withColumns(filled).select(*[ref(c) for c in df.columns])


def cumulative_counts(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """For rows (by, value, n), one per value: ``before``, the count of smaller values in the
    group, and ``total``, the count of the group."""
    rows = with_block(counts, [*by, value])
    per_block = _open_groups(rows.groupBy(*by, "_block").agg(F.sum("n").alias("_n")), by)
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *by, "_block",
        F.sum("_n").over(earlier).alias("_offset"),
        F.sum("_n").over(group).alias("_all"),
    )
    local = Window.partitionBy(*by, "_block")
    here = local.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _attach(rows, carried, by).select(
        *counts.columns,
        (F.coalesce("_offset", F.lit(0)) + F.sum("n").over(here) - F.col("n")).alias("before"),
        F.coalesce("_all", F.sum("n").over(local)).alias("total"),
    )


def _interpolated(low: Column, high: Column, share: Column) -> Column:
    return low + (high - low) * share


def percentiles(
    df: DataFrame,
    column: str,
    shares: list[float],
    by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation: (by, n, lowest, highest, quantiles).

    Selection by bracketing, in two scans and without a shuffle of values. The first scan makes
    a mergeable quantile sketch per group (``percentile_approx``, rank error at most
    n / ``ACCURACY``), and reads brackets [lo, hi] at each share minus and plus twice that error.
    The second counts the values below lo, equal to lo and equal to hi, and keeps only the values
    strictly between them - some 4n / ``ACCURACY`` per share and group, ties at the ends counted,
    never kept. The wanted ranks then fall in the bracket, where they are read exactly. Should a
    bracket miss a rank, that group is ranked by blocks instead (``ranked_percentiles``), so the
    result is exact in every case and has the same bits at any size. Groups with no value give
    NULL."""
    by = list(by or [])
    require(df, column, *by)
    values = df.select(*[ref(b).alias(f"_by{i}") for i, b in enumerate(by)], as_number(df, column).alias("_value"))
    keys = [f"_by{i}" for i in range(len(by))]
    margin = 2.0 / ACCURACY
    ends = [x for s in shares for x in (max(0.0, s - margin), min(1.0, s + margin))]
    sketch = values.groupBy(*keys).agg(
        F.count("_value").alias("n"), F.min("_value").alias("lowest"), F.max("_value").alias("highest"),
        F.percentile_approx("_value", F.array(*[F.lit(e) for e in ends]), ACCURACY).alias("_ends"))
    if keys:  # one row per group, written: the size of its files decides how Spark joins it, so
        # the values are not dealt by a few groups
        sketch = stage(sketch)
        joined = values.join(sketch.select(*[F.col(k).alias(f"_s{k}") for k in keys], "_ends"),
                             F.expr(" AND ".join(f"{k} <=> _s{k}" for k in keys)))
    else:  # the whole table: one row, read as literals
        row = sketch.first()
        sketch = values.sparkSession.createDataFrame([tuple(row)], sketch.schema)
        joined = values.withColumn("_ends", F.lit(row["_ends"]).cast("array<double>"))
    v, parts = F.col("_value"), []
    for i in range(len(shares)):
        lo, hi = F.col("_ends")[2 * i], F.col("_ends")[2 * i + 1]
        parts += [
            F.count(F.when(v < lo, 1)).alias(f"_below{i}"),
            F.count(F.when(v == lo, 1)).alias(f"_atlo{i}"),
            F.count(F.when((v == hi) & (hi != lo), 1)).alias(f"_athi{i}"),
            F.array_sort(F.collect_list(F.when((v > lo) & (v < hi), v))).alias(f"_inside{i}"),
        ]
    counted = joined.groupBy(*keys).agg(*parts)
    if keys:
        counted = counted.select(*[F.col(k).alias(f"_c{k}") for k in keys], *[c for c in counted.columns if c not in keys])
        found = sketch.join(counted, F.expr(" AND ".join(f"{k} <=> _c{k}" for k in keys)), "left")
    else:
        found = _one_row(sketch, counted)
    quantiles, misses = [], F.lit(False)
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("n") - 1)
        read = []
        for index in (F.floor(place), F.ceil(place)):
            below, atlo = F.col(f"_below{i}"), F.col(f"_atlo{i}")
            inside, athi = F.col(f"_inside{i}"), F.col(f"_athi{i}")
            lo, hi = F.col("_ends")[2 * i], F.col("_ends")[2 * i + 1]
            after_lo, after_inside = below + atlo, below + atlo + F.size(inside)
            value = (F.when(index < below, F.lit(None))
                     .when(index < after_lo, lo)
                     .when(index < after_inside, F.get(inside, (index - after_lo).cast("int")))
                     .when(index < after_inside + athi, hi))
            misses = misses | ((F.col("n") > 0) & value.isNull())
            read.append(value)
        quantiles.append(_interpolated(read[0], read[1], place - F.floor(place)))
    result = found.select(
        *[F.col(k).alias(b) for k, b in zip(keys, by)], "n", "lowest", "highest",
        F.when(F.col("n") > 0, F.array(*quantiles)).alias("quantiles"), misses.alias("_missed"))
    result = stage(result)
    if not result.filter("_missed").isEmpty():
        missed = result.filter("_missed").select(*[ref(b).alias(f"_m{i}") for i, b in enumerate(by)])
        held = F.expr(" AND ".join(f"`{b}` <=> _m{i}" for i, b in enumerate(by))) if by else None
        again = ranked_percentiles(df.join(missed, held, "left_semi") if by else df, column, shares, by)
        return result.filter(~F.col("_missed")).drop("_missed").unionByName(again)
    return result.drop("_missed")


def _one_row(sketch: DataFrame, counted: DataFrame) -> DataFrame:
    """The one row of a whole-table sketch beside the one row of its counts."""
    row = counted.first()
    return sketch.select("*", *[F.lit(row[c]).alias(c) for c in counted.columns])


def ranked_percentiles(
    df: DataFrame,
    column: str,
    shares: list[float],
    by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, as ``percentiles``, by ranking all distinct
    values in blocks: the values are counted once, kept, and ranked by blocks, so no task holds
    a group."""
    by = list(by or [])
    require(df, column, *by)
    values = df.select(*[ref(b) for b in by], as_number(df, column).alias("_value"))
    counts = stage(values.groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("n")))
    ranked = cumulative_counts(counts.filter(F.col("_value").isNotNull()), by, "_value")
    picked = []
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("total") - 1)
        for end, index in (("low", F.floor(place)), ("high", F.ceil(place))):
            inside = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
            picked.append(F.max(F.when(inside, F.col("_value"))).alias(f"{end}{i}"))
    found = ranked.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("_value").alias("lowest"),
        F.max("_value").alias("highest"), *picked,
    )
    quantiles = []
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("n") - 1)
        quantiles.append(
            _interpolated(F.col(f"low{i}"), F.col(f"high{i}"), place - F.floor(place))
        )
    found = found.select(*by, "n", "lowest", "highest", F.array(*quantiles).alias("quantiles"))
    if not by:
        return found
    # groups whose values are all missing
    empty = counts.groupBy(*by).agg(F.count("_value").alias("n")).filter(F.col("n") == 0)
    return found.unionByName(empty, allowMissingColumns=True)


def column_percentiles(
    df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """Exact percentiles of several columns in one pass: one row per column."""
    numbers = df.select(*[as_number(df, c).alias(c) for c in columns])
    long = numbers.unpivot([], [ref(c) for c in columns], "column", "value")
    return percentiles(long, "value", shares, ["column"])


def row_positions(df: DataFrame, order_by: list[str], name: str = "position") -> DataFrame:
    """Number all rows from 1 in the order of ``order_by``."""
    rows = with_block(df, order_by)
    counts = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("_block", F.sum("_n").over(earlier).alias("_offset"))
    here = Window.partitionBy("_block").orderBy(*[ref(c) for c in order_by])
    joined = _attach(rows, carried, [])
    place = F.coalesce("_offset", F.lit(0)) + F.row_number().over(here)
    return joined.select(*[ref(c) for c in df.columns], place.cast("bigint").alias(name))


def order_correlation(df: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    """Spearman correlation of each column with the row order: (column, n, spearman).

    Row numbers count the rows where the column has a value. They are summed per distinct value,
    so ranks are never joined back to the rows: equal values share one average rank."""
    require(df, *columns, *order_by)
    narrow = df.select(*[ref(c).alias(f"_o{i}") for i, c in enumerate(order_by)],
                       *[as_number(df, c).alias(f"_v{i}") for i, c in enumerate(columns)])
    order = [f"_o{i}" for i in range(len(order_by))]
    rows = with_block(narrow, order)
    per_block = rows.groupBy("_block").agg(
        *[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(columns))]
    )
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select("_block", *[
        F.sum(f"_n{i}").over(earlier).alias(f"_offset{i}") for i in range(len(columns))
    ])
    here = (Window.partitionBy("_block").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = _attach(rows, carried, []).select(*[
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"_v{i}").alias("value"),
            (F.coalesce(f"_offset{i}", F.lit(0)) + F.count(f"_v{i}").over(here)).alias("place"),
        ).alias(f"_p{i}")
        for i, c in enumerate(columns)
    ])
    long = placed.select(F.inline(F.array(*[f"_p{i}" for i in range(len(columns))])))
    counts = stage(
        long.filter(F.col("value").isNotNull()).groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("place").cast("double")).alias("places"))
    )
    ranked = cumulative_counts(counts, ["column"], "value")
    total = F.col("total").cast("double")
    centre = (total + 1) / 2
    rank = F.col("before") + (F.col("n") + 1) / 2 - centre
    sums = ranked.groupBy("column").agg(
        F.max("total").alias("n"),
        F.sum(rank * (F.col("places") - F.col("n") * centre)).alias("both"),
        F.sum(F.col("n") * rank * rank).alias("ranks"),
        F.max(total * (total * total - 1) / 12).alias("order"),
    )
    spread = F.sqrt(F.col("ranks") * F.col("order"))
    return sums.select("column", "n", F.try_divide("both", spread).alias("spearman"))
