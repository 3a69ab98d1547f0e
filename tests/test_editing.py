import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.actions import add_column, apply_actions, change_type, fill_missing
from tallyloom.operators.forecasting import fit_trend, forecast, forecast_summary
from tallyloom.operators.questions import carry_context, tag_questions
from tallyloom.operators.staging import shared_folder, stage
from tallyloom.sources import preview_page, read_table, sample_rows, write_table
from tallyloom.sources.preview import page_numbers
from tallyloom.streaming import apply_actions_to_stream


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [(1, 2.0, "x", None), (2, 0.0, "5", 1.0), (3, 4.0, None, 1.0)],
        "a int, b double, c string, d double")


def test_add_column(table):
    def values(expression):
        return [r["e"] for r in add_column(table, "e", expression).orderBy("a").collect()]

    assert values("a / b") == [0.5, None, 0.75]
    assert values("-(a + b) * 2 - 1.5") == [-7.5, -5.5, -15.5]
    assert values("10") == [10, 10, 10]
    for bad in ("", "a ** 2", "a // 2", "a * (b", "a; b", "a.b", "c + 1", "nope + 1", "a b", "1 / 0",
                "a(b)", "__import__"):
        with pytest.raises(ValueError):
            values(bad)
    with pytest.raises(ValueError):
        add_column(table, "a", "b + 1")


def test_change_type(spark, table):
    with pytest.raises(ValueError, match="Problematic values: \\['x'\\]"):
        change_type(table, "c", "int")
    assert [r["c"] for r in change_type(table, "c", "int", strict=False).orderBy("a").collect()] == [
        None, 5, None]
    halves = spark.createDataFrame([(1.5,), (2.0,)], "v double")
    with pytest.raises(ValueError):
        change_type(halves, "v", "int")
    with pytest.raises(ValueError):
        change_type(table, "c", "complex")
    days = spark.createDataFrame([("2024-02-29",), ("03/01/2024",)], "d string")
    found = [r["d"] for r in change_type(days, "d", "datetime").collect()]
    assert found == [datetime.datetime(2024, 2, 29), datetime.datetime(2024, 3, 1)]
    long = spark.createDataFrame([("9007199254740993",)], "k string")
    assert change_type(long, "k", "int").first()[0] == 9007199254740993


def test_fill_missing(table):
    def values(column, strategy, **options):
        return [r[column] for r in
                fill_missing(table, column, strategy, **options).orderBy("a").collect()]

    assert values("d", "mean") == [1.0, 1.0, 1.0]
    assert values("d", "median") == [1.0, 1.0, 1.0]
    assert values("c", "mode") == ["x", "5", "5"]
    assert values("c", "constant", value="n") == ["x", "5", "n"]
    assert values("d", "zero") == [0.0, 1.0, 1.0]
    assert values("c", "forward_fill", order_by=["a"]) == ["x", "5", "5"]
    for column, strategy in (("c", "mean"), ("d", "constant"), ("d", "best"), ("x", "zero"),
                             ("d", "forward_fill")):
        with pytest.raises(ValueError):
            values(column, strategy)
    empty = table.withColumn("c", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="no mode found"):
        fill_missing(empty, "c", "mode").collect()


def test_actions(table):
    out = apply_actions(table, [
        {"type": "rename_column", "params": {"column": "b", "new_name": "bb"}},
        {"type": "filter_rows", "params": {"column": "bb", "operator": ">", "value": 1}},
        {"type": "drop_column", "params": {"column": "c"}}])
    assert out.columns == ["a", "bb", "d"] and out.count() == 2
    for bad in ({"type": "explode"}, {"type": "drop_column", "params": {"column": "zz"}},
                {"type": "rename_column", "params": {"column": "a", "new_name": "b"}}):
        with pytest.raises(ValueError):
            apply_actions(table, [bad])


def test_stream(spark, tables, tmp_path):
    tables.events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tables.events.schema).parquet(str(tmp_path / "in"))
    edited = apply_actions_to_stream(stream, [
        {"type": "filter_rows", "params": {"column": "event_type", "operator": "==", "value": "click"}},
        {"type": "add_column", "params": {"new_column": "twice", "expression": "value * 2"}}])
    run = (edited.writeStream.format("memory").queryName("edited_events")
           .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    run.awaitTermination(120)
    found = spark.sql("SELECT count(*), sum(twice - 2 * value) FROM edited_events").first()
    assert found[0] == tables.events.filter("event_type = 'click'").count() and found[1] == 0
    with pytest.raises(ValueError):
        apply_actions_to_stream(stream, [
            {"type": "fill_missing", "params": {"column": "value", "strategy": "mean"}}])


def test_files(spark, tables, tmp_path):
    path = str(tmp_path / "orders.csv")
    write_table(tables.orders, path)
    again = read_table(spark, path)
    assert again.columns == tables.orders.columns and again.count() == tables.orders.count()
    assert dict(again.dtypes)["o_totalprice"] == "double"
    both = read_table(spark, [path, path], schema=again.schema)
    assert both.count() == 2 * again.count()
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "table.xlsx"))
    write_table(tables.orders.filter("o_orderkey < 0"), str(tmp_path / "none.parquet"), "parquet")
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "none.parquet"))
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    write_table(nan, str(tmp_path / "nan.parquet"), "parquet")
    assert read_table(spark, str(tmp_path / "nan.parquet")).filter("v IS NULL").count() == 1


def test_previews(spark):
    df = spark.range(120)
    rows, facts = preview_page(df, ["id"], page=9, page_size=50)
    assert [r[0] for r in rows.collect()] == list(range(100, 120)) and facts["page"] == 3
    far, _ = preview_page(spark.range(600_000), ["id"], page=12_000, page_size=50)
    assert [r[0] for r in far.collect()] == list(range(599_950, 600_000))
    assert page_numbers(0, 4, 10) == (1, 10, 0) and page_numbers(5000, -1, 9999) == (1, 500, 10)
    big = spark.range(20_000)
    chosen = sample_rows(big, 1500, ["id"])
    assert chosen.count() == 1500 == chosen.distinct().count()
    assert {r[0] for r in chosen.collect()} == {r[0] for r in sample_rows(big, 1500, ["id"]).collect()}
    copies = big.select((F.col("id") % 2).alias("id"))
    assert sample_rows(copies, 1500, ["id"]).count() == 1500


def test_forecast(spark):
    line = spark.createDataFrame(
        [(datetime.date(2024, m, 1), 10.0 * m) for m in range(1, 7)], "period_start date, value double")
    fit = fit_trend(line, "value", "period_start").first()
    assert (fit["n"], fit["slope"], fit["intercept"]) == (6, pytest.approx(10), pytest.approx(10))
    rows = forecast(line).orderBy("step").collect()
    assert [r["period"] for r in rows] == ["Jul 2024", "Aug 2024", "Sep 2024", "Oct 2024"]
    assert rows[0]["expected"] == 70.0
    said = forecast_summary(line, metric_name="Sales").first()
    assert said["direction"] == "Bullish Growth" and said["projected_growth"] == "+28.6%"
    flat = spark.createDataFrame([(1, 100.0), (2, 100.0)], "t int, value double")
    row = forecast(flat, order="t").orderBy("step").first()
    assert (row["period"], row["expected"], row["best_case"], row["worst_case"]) == (
        "Period +1", 100.0, 109.8, 90.2)
    falling = spark.createDataFrame([(1, 10.0), (2, 1.0)], "t int, value double")
    assert forecast(falling, order="t").agg(F.min("expected")).first()[0] == 0.0
    assert forecast(flat.limit(1), order="t").count() == 0


QUESTIONS = [
    (1, 1, "Show sales by region for the last 3 months"),
    (1, 2, "now by category"),
    (1, 3, "Compare Sales vs Profit in 2023 for every single one of our markets"),
    (1, 4, "what about north"),
    (2, 1, "Worst 3 products this year"),
    (2, 2, "Give me an overview of everything"),
    (2, 3, "drop column x"),
]


def test_questions(spark):
    df = spark.createDataFrame(QUESTIONS, "s int, turn int, text string")
    tagged = tag_questions(df, metrics=["Sales", "Profit"], dimensions=["Region", "Category"],
                           values={"Region": ["North", "South"]})
    rows = {(r["s"], r["turn"]): r for r in carry_context(tagged, ["s"], ["turn"]).collect()}
    assert tuple(rows[1, 1]["time"]) == ("last_n", 3, "month", None)
    assert rows[1, 2]["metrics"] == ["Sales"] and rows[1, 2]["dimensions"] == ["Category"]
    assert rows[1, 2]["time"]["kind"] == "last_n"
    third = rows[1, 3]
    assert tuple(third["comparison"]) == ("sales", "profit") and not third["is_follow_up"]
    assert third["time"]["year"] == 2023 and third["dimensions"] == []
    fourth = rows[1, 4]
    assert fourth["metrics"] == ["Sales", "Profit"] and fourth["time"]["year"] == 2023
    assert [tuple(f) for f in fourth["filters"]] == [("Region", "North")]
    assert tuple(rows[2, 1]["ranking"]) == ("bottom", 3) and rows[2, 1]["time"]["kind"] == "this_year"
    assert rows[2, 2]["is_overview"] and rows[2, 3]["is_edit"]


def test_named_folder_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = shared_folder(spark)
    assert folder == (named or folder)
    kept = stage(spark.range(5))
    assert kept.count() == 5
    assert all(folder.removeprefix("file:") in f for f in kept.inputFiles())
