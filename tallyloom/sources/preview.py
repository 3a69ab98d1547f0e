"""Pages, first rows and fixed-size samples of a table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.columns import nan_to_null, ref, require
from tallyloom.operators.ordered import _sorted_key, row_positions, split_points, with_block

# --- fixed values: preview ----------------------------------------------------------------
PAGE_SIZE, LARGEST_PAGE = 50, 500
SAMPLE_RECORDS = 5
PROFILE_SAMPLE_ROWS, SAMPLE_SEED = 200_000, 42

#: Ranges of hashes that are counted to find a sample's last one.
HASH_RANGES = 4096
#: Rows per block of a page index, about: a page numbers at most the rows of the blocks it touches.
FENCE_ROWS = 1_000_000


def page_fences(df: DataFrame, order_by: list[str]) -> dict:
    """A sparse index of ``df`` in the order of ``order_by`` (whose last column is unique): the
    border keys between blocks of about ``FENCE_ROWS`` rows, and each block's rows and rows
    before it. One count, one sample for the borders and one count per block; kept by the caller
    and used for any number of pages. Its size is one row per block."""
    require(df, *order_by)
    total = df.count()
    blocks = max(2, -(-total // FENCE_ROWS))
    borders = df.sparkSession.range(1).select(split_points(df, order_by, blocks).alias("c")).first()["c"] or []
    counted = with_block(df, order_by, blocks).groupBy("_block").count().collect()
    rows = [0] * (len(borders) + 1)
    for r in counted:
        rows[r["_block"]] = r["count"]
    before = [sum(rows[:b]) for b in range(len(rows))]
    return {"order_by": list(order_by), "borders": [tuple(b) for b in borders], "rows": rows,
            "before": before, "total": total}


def _at_or_after(order_by: list[str], low: tuple) -> Column:
    """The key of the row is at or after ``low`` (nulls first, as Spark sorts)."""
    return _sorted_key(order_by) >= F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(low)])


def _before(order_by: list[str], high: tuple) -> Column:
    return _sorted_key(order_by) < F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(high)])


def fenced_page(df: DataFrame, fences: dict, page: int = 1, page_size: int = PAGE_SIZE) -> tuple[DataFrame, dict]:
    """One page by a page index: only the blocks that hold the page are read and numbered. Their
    key range is a filter of the scan; on the first order column it is a plain comparison that
    reaches the Parquet reader."""
    order_by, borders, total = fences["order_by"], fences["borders"], fences["total"]
    shown, size, pages = page_numbers(total, page, page_size)
    first, last = (shown - 1) * size, min(shown * size, total)
    touched = [b for b, (n, at) in enumerate(zip(fences["rows"], fences["before"])) if at < last and at + n > first]
    keep = F.lit(True)
    lead = ref(order_by[0])
    if touched and touched[0] > 0:
        low = borders[touched[0] - 1]
        keep = keep & _at_or_after(order_by, low)
        if low[0] is not None:
            keep = keep & (lead >= F.lit(low[0]))
    if touched and touched[-1] < len(borders):
        high = borders[touched[-1]]
        keep = keep & _before(order_by, high)
        if high[0] is not None:
            keep = keep & ((lead <= F.lit(high[0])) | lead.isNull())
    offset = fences["before"][touched[0]] if touched else 0
    place = F.lit(offset) + F.row_number().over(Window.orderBy(*[ref(c) for c in order_by]))
    rows = df.filter(keep).withColumn("_position", place).filter(
        (F.col("_position") > first) & (F.col("_position") <= last)).orderBy("_position").drop("_position")
    facts = {"total_rows": total, "page": shown, "page_size": size, "total_pages": pages}
    return nan_to_null(rows), facts


def page_numbers(total_rows: int, page: int, page_size: int) -> tuple[int, int, int]:
    """The page that can be shown, its size, and how many pages there are."""
    size = max(1, min(page_size, LARGEST_PAGE))
    pages = (total_rows + size - 1) // size
    return (min(max(page, 1), pages) if pages else 1), size, pages


def preview_page(
    df: DataFrame, order_by: list[str], page: int = 1, page_size: int = PAGE_SIZE
) -> tuple[DataFrame, dict]:
    """One page of rows in the order of ``order_by``, and the page facts. The count that clamps
    the page is one job. The page is found by row number, so that the rows before it do not meet
    in one task."""
    require(df, *order_by)
    total = df.count()
    shown, size, pages = page_numbers(total, page, page_size)
    skipped = (shown - 1) * size
    place = F.col("_position")
    rows = row_positions(df, order_by, "_position").filter(
        (place > skipped) & (place <= skipped + size)).orderBy("_position").drop("_position")
    rows = nan_to_null(rows)
    facts = {"total_rows": total, "page": shown, "page_size": size, "total_pages": pages}
    return rows, facts


def sample_records(df: DataFrame, order_by: list[str], n: int = SAMPLE_RECORDS) -> DataFrame:
    """The first rows, points in time as text."""
    require(df, *order_by)
    first = df.orderBy(*order_by).limit(n)
    times = [f.name for f in df.schema if f.dataType.typeName().startswith("timestamp")]
    return first.withColumns({c: ref(c).cast("string") for c in times}) if times else first


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int = SAMPLE_SEED) -> DataFrame:
    """A sample of exactly ``n`` rows, or all of a smaller table, that is the same on each run:
    the rows with the smallest hash of ``key``. Rows are counted per range of hashes; only the
    ranges that the sample needs are numbered, in blocks, so the sample may be of any size."""
    require(df, *key)
    hashed = df.withColumn("_hash", F.xxhash64(*[ref(c) for c in key], F.lit(seed)))
    width = 64 - (HASH_RANGES - 1).bit_length()
    span = F.shiftright(F.col("_hash"), width)
    counts = {r["_range"]: r["n"] for r in hashed.groupBy(span.alias("_range")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    held = last = None
    for last in sorted(counts):
        held = (held or 0) + counts[last]
        if held >= n:
            break
    near = hashed if last is None else hashed.filter(span <= last)
    return row_positions(near, ["_hash", *key], "_position").filter(
        F.col("_position") <= n).drop("_hash", "_position")
