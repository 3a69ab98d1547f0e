"""Block-wise operators against pandas, with one key that holds most of the rows."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ordered
from tallyloom.operators.ordered import (
    cumulative_counts, forward_fill, order_correlation, percentiles, row_positions, with_block,
)
from conftest import plan_of
from tallyloom.operators.staging import lookup, stage


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    frame = pd.DataFrame({
        "id": np.arange(n),
        "k": np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 20, n).astype(str)),
        "v": np.round(rng.normal(size=n).cumsum(), 2),
        "w": rng.integers(0, 5, n).astype(float),
    })
    frame.loc[rng.random(n) < 0.5, "v"] = np.nan
    frame.loc[:40, "v"] = np.nan
    frame.loc[rng.random(n) < 0.05, "k"] = None
    df = spark.createDataFrame(frame.sample(frac=1, random_state=1)).withColumn(
        "v", F.nanvl("v", F.lit(None))).withColumn("w", F.nanvl("w", F.lit(None)))
    return frame, df.repartition(5)


def test_blocks_follow_the_order(skewed):
    _, df = skewed
    spans = with_block(df, ["k", "id"], 16).groupBy("_block").agg(
        F.min(F.struct("k", "id")).alias("lo"), F.max(F.struct("k", "id")).alias("hi"),
        F.count("*").alias("n")).orderBy("_block").collect()
    assert 8 < len(spans) <= 16
    key = lambda s: (s["k"] is not None, s["k"] or "", s["id"])
    assert all(key(a["hi"]) < key(b["lo"]) for a, b in zip(spans, spans[1:]))
    assert max(s["n"] for s in spans) < 3000 / 4


def test_forward_fill(skewed):
    frame, df = skewed
    found = forward_fill(df, ["v"], ["id"]).toPandas().sort_values("id")
    assert np.allclose(found.v, frame.v.ffill(), equal_nan=True)
    found = forward_fill(df, ["v"], ["id"], ["k"]).toPandas().sort_values("id")
    expected = frame.groupby(frame.k.fillna("none")).v.ffill()
    assert np.allclose(found.v, expected, equal_nan=True)


def test_positions(skewed):
    _, df = skewed
    found = row_positions(df.drop("v"), ["k", "id"]).toPandas()
    ordered = found.assign(known=found.k.notna(), key=found.k.fillna("")).sort_values(
        ["known", "key", "id"])
    assert ordered.position.tolist() == list(range(1, 3001))


def test_percentiles_both_ways(skewed):
    frame, df = skewed
    shares = [0.01, 0.25, 0.5, 0.9]
    for limit in (10_000, 0):
        rows = {r["k"]: r for r in percentiles(df, "v", shares, ["k"]).collect()}
        for name, group in frame.groupby(frame.k.fillna("none")):
            row = rows[None if name == "none" else name]
            values = group.v.dropna()
            assert row["n"] == len(values)
            assert np.allclose(row["quantiles"], values.quantile(shares))
            assert (row["lowest"], row["highest"]) == (values.min(), values.max())
        whole = percentiles(df, "v", shares, None).first()
        assert np.allclose(whole["quantiles"], frame.v.quantile(shares))


def test_running_counts(skewed):
    frame, df = skewed
    counts = stage(df.groupBy("k", "w").agg(F.count("*").alias("n")))
    rows = cumulative_counts(counts, ["k"], "w").collect()
    hot = frame[frame.k == "hot"]
    for r in (r for r in rows if r["k"] == "hot"):
        assert r["before"] == (hot.w < r["w"]).sum() and r["total"] == len(hot)


def test_order_correlation(skewed):
    frame, df = skewed
    found = {r["column"]: r for r in order_correlation(df, ["v", "w"], ["id"]).collect()}
    for name in ("v", "w"):
        known = frame.dropna(subset=[name])
        expected = known[name].rank().corr(known.id.rank())
        assert found[name]["n"] == len(known)
        assert found[name]["spearman"] == pytest.approx(expected, abs=1e-9)


def test_constant_column_has_no_order(spark):
    df = spark.range(20).withColumn("c", F.lit(1.0))
    assert order_correlation(df, ["c"], ["id"]).first()["spearman"] is None


def test_lookups_agree_by_broadcast_and_by_shuffle(skewed):
    frame, df = skewed
    table = stage(df.filter("k IS NOT NULL").select(F.col("k").alias("key")).distinct()
                  .withColumn("new", F.repeat(F.upper("key"), 5000)).filter("key <> '3'"))
    small = lookup(df, table, F.col("k"), "key")
    assert "BroadcastHashJoin" in plan_of(small)
    before = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = lookup(df, table, F.col("k"), "key")
        assert "BroadcastHashJoin" not in plan_of(large)
        found = sorted(large.collect(), key=lambda r: r["id"])
    finally:
        df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert small.columns == large.columns == ["id", "k", "v", "w", "new"]
    assert sorted(small.collect(), key=lambda r: r["id"]) == found


def test_few_rows(spark):
    one = spark.createDataFrame([(1, None)], "id int, v double")
    assert forward_fill(one, ["v"], ["id"]).collect()[0]["v"] is None
    none = one.filter("id > 1")
    assert forward_fill(none, ["v"], ["id"]).count() == 0
    assert percentiles(one, "v", [0.5], None).first()["quantiles"] in (None, [None])


def test_percentiles_by_brackets_equal_ranking_by_blocks(spark):
    from tallyloom.operators import ordered

    rows = ([(1, 5.0)] * 3 + [(1, 7.0), (2, None), (3, 1.0), (None, 2.0), (None, 4.0)]
            + [(4, 5.0)] * 3000 + [(4, float(i)) for i in range(300)] + [(5, float(i % 17)) for i in range(5000)])
    df = spark.createDataFrame(rows, "g int, v double")
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    for by in (["g"], None):
        bracketed = ordered.percentiles(df, "v", shares, by).collect()
        ranked = ordered.ranked_percentiles(df, "v", shares, by).collect()
        assert sorted(map(tuple, bracketed), key=repr) == sorted(map(tuple, ranked), key=repr)
    [empty] = ordered.percentiles(df.limit(0), "v", [0.5]).collect()
    assert empty.n == 0 and empty.quantiles is None


def test_pages_by_fences_equal_pages_by_row_number(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tallyloom.sources import preview

    monkeypatch.setattr(preview, "FENCE_ROWS", 37)  # many blocks, pages across borders
    df = spark.range(1000).select(
        F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 13).alias("k"), F.col("id").alias("u"),
        (F.col("id") * 1.5).alias("v"))
    fences = preview.page_fences(df, ["k", "u"])
    assert len(fences["rows"]) > 20 and sum(fences["rows"]) == 1000
    for page in (1, 2, 7, 19, 20, 21, 99):
        fenced, facts = preview.fenced_page(df, fences, page, 50)
        plain, plain_facts = preview.preview_page(df, ["k", "u"], page, 50)
        assert facts == plain_facts
        assert [tuple(r) for r in fenced.collect()] == [tuple(r) for r in plain.collect()]


def test_far_page_filters_the_scan(spark):
    from conftest import DATA, plan_of
    from tallyloom.sources import preview

    orders = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_totalprice")
    fences = preview.page_fences(orders, ["o_orderkey"])
    fenced, _ = preview.fenced_page(orders, fences, 25, 50)
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey" in plan_of(fenced) or \
        "GreaterThanOrEqual(o_orderkey" in plan_of(fenced)


def test_values_are_not_dealt_by_group(spark, tmp_path, monkeypatch):
    """The sketches are written before the join, so a few groups are broadcast whatever the table's size."""
    path = str(tmp_path / "values")
    spark.range(200_000).selectExpr("id % 3 AS g", "cast(id * 7919 % 100003 AS double) AS v").write.parquet(path)
    plans, kept = [], ordered.stage

    def staged(df):
        plans.append(plan_of(df))
        return kept(df)

    monkeypatch.setattr(ordered, "stage", staged)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        found = ordered.percentiles(spark.read.parquet(path), "v", [0.5], ["g"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found) == 3
    values = [e.split("ObjectHashAggregate")[-1] for e in plans if "collect_list" in e]
    assert values and all("BroadcastHashJoin" in e and "SortMergeJoin" not in e for e in values)
