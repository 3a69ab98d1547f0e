import pytest
from pyspark.sql import functions as F

from tallyloom.operators.cleaning import (
    cleaning_summary, date_columns, normalize_categories, outlier_counts, spelling_report,
    spellings, value_counts, winsorize,
)
from tallyloom.operators.privacy import mask, masked_preview, personal_data
from tallyloom.operators.profiling import column_roles, kpi_columns, profile
from tallyloom.operators.quality import correlation_matrix, drift
from tallyloom.plans.cleanup import clean
from tallyloom.plans.overview import overview, summary

COUNTRIES = ["USA", "usa", " United States ", "UK", "u.k.", "Germany", "US", " France "]


def test_country_spelling(spark):
    df = spark.createDataFrame([(c,) for c in COUNTRIES], "country string")
    found = {r[0] for r in normalize_categories(df).collect()}
    assert found == {"United States", "United Kingdom", "Germany", "France"}
    report = spelling_report(spellings(value_counts(df, ["country"]))).first()
    assert report["values_normalized"] == 7 and len(report["examples"]) == 5
    own = normalize_categories(df, synonyms={"GERMANY": "DE"})
    assert "DE" in {r[0] for r in own.collect()}


def test_most_frequent_spelling_wins(spark):
    df = spark.createDataFrame([(c,) for c in ["ab", "AB", "AB ", "Cd", "cD", None]], "t string")
    found = sorted(str(r[0]) for r in normalize_categories(df).collect())
    assert found == ["AB", "AB", "AB", "Cd", "Cd", "None"]


def test_date_columns(spark):
    df = spark.createDataFrame(
        [("2024-01-05", "x", "5 Jan 2024", "12"), ("2024-02-30", "y", "6 Jan 2024", "5")],
        "when_date string, t string, d string, n string")
    found = {r["column"]: (r["parsed_share"], r["is_date"]) for r in date_columns(df).collect()}
    assert found == {"when_date": (0.5, True), "t": (0.0, False), "d": (1.0, True),
                     "n": (0.0, False)}


def test_outliers(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in [*range(50), 5000]], "v double, c double")
    found = {r["column"]: r["outliers"] for r in outlier_counts(df).collect()}
    assert found == {"v": 1, "c": 0}
    clipped = winsorize(df)
    assert clipped.agg(F.max("v")).first()[0] == pytest.approx(2524.5)
    assert clipped.agg(F.min("v")).first()[0] == pytest.approx(0.5)


def test_clean(spark):
    rows = [(i, f"2024-01-{i % 28 + 1:02d}", None if i % 4 == 0 else float(i),
             None if i == 3 else ("red" if i % 3 else "RED "), None if i % 2 else "x",
             None if i == 5 else i % 7)
            for i in range(1, 61)]
    df = spark.createDataFrame(rows + rows[:5],
                               "id int, day string, level double, color string, rare string, n int")
    frame, report = clean(df, order_by=["id"])
    notes = {(r["column"], r["step"]): (r["action"], r["count"]) for r in report.collect()
             if r["step"] != "example"}
    assert notes[(None, "duplicates")] == ("removed", 5)
    assert notes[("level", "missing")] == ("forward_fill", 15)
    assert notes[("color", "missing")] == ("mode", 1)
    assert notes[("rare", "missing")] == ("skipped_high_missing", 30)
    assert notes[("n", "missing")] == ("median", 1)
    assert notes[("color", "categories")][0] == "normalized"
    assert ("id", "outliers") not in notes
    found = {r["id"]: r for r in frame.collect()}
    assert len(found) == 60
    assert found[4]["level"] == 3.0 and found[1]["level"] == 1.0 and found[8]["level"] == 7.0
    assert {r["color"] for r in found.values()} == {"red"}
    assert found[5]["n"] == 3.0
    said = [r["sentence"] for r in cleaning_summary(report).collect()]
    assert "level: forward-filled (15 missing values)" in said or any(
        s.startswith("level: forward-filled") for s in said)
    assert "rare: 50.0% missing — left as-is, flagged for review" in said


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, "US", 10.0, "2024-01-01", 2024), (2, "DE", 30.0, "2024-01-02", 2024)],
        "user_id int, home string, sales double, day string, year int")
    facts = profile(df)
    rows = {r["column"]: r for r in facts.collect()}
    assert [rows[c]["semantic_role"] for c in df.columns] == [
        "identifier", "geographical", "kpi", "date", "temporal_discrete"]
    assert rows["sales"]["median"] == 20.0 and rows["sales"]["default_aggregation"] == "sum"
    assert rows["home"]["sample_values"] == ["DE", "US"] and rows["home"]["geo_confidence"] == 0.5
    assert column_roles(facts) == {"numbers": ["sales", "year"], "dates": ["day"],
                                   "categories": ["home"], "kpis": ["sales"]}
    assert [r["column"] for r in kpi_columns(facts).collect()] == ["sales"]
    only_ids = profile(df.select("user_id", "year"))
    assert [r["column"] for r in kpi_columns(only_ids).collect()] == ["year"]


def test_profile_of_missing_columns(spark):
    df = spark.createDataFrame([(None, None)], "a double, b string")
    rows = {r["column"]: r for r in profile(df).collect()}
    assert rows["a"]["missing_pct"] == 100.0 and rows["a"]["mean"] == 0.0
    assert rows["b"]["unique_count"] == 0


def test_correlation_of_constant_and_gaps(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)],
                               "x double, y double, k double")
    found = {(r["col_a"], r["col_b"]): r["r"] for r in correlation_matrix(df).collect()}
    assert found[("x", "y")] == found[("y", "x")] == 1.0
    assert found[("k", "k")] == 0.0 and found[("x", "k")] == 0.0 and len(found) == 9


def test_personal_data(spark):
    df = spark.createDataFrame(
        [("a@b.org", "555-123-4567", 1), ("none", "555-123-4567", 2)],
        "contact string, phone string, id int")
    found = {r["column"]: r for r in personal_data(df).collect()}
    assert found["contact"]["confidence"] == 0.95
    assert found["contact"]["reason"] == "1/2 values match email format"
    assert found["phone"]["reason"].startswith("column name matches phone pattern; 2/2")
    first = masked_preview(df, ["id"]).first()
    assert tuple(first) == ("a***@***.org", "***-***-4567")


@pytest.mark.parametrize("kind, value, shown", [
    ("email", "joe@mail.example.com", "j***@***.com"), ("email", "joe", "***@***.***"),
    ("phone", "12", "***-***-****"), ("ssn", "123-45-6789", "***-**-6789"),
    ("credit_card", "4111 1111 1111 1234", "**** **** **** 1234"),
    ("ip_address", "10.0.0.7", "***.***.***.7"), ("ip_address", "10", "***.***.***.***"),
    ("name", "Ada", "A***"), ("name", "", "***"), ("ssn", None, None),
])
def test_masks(spark, kind, value, shown):
    assert spark.range(1).select(mask(F.lit(value).cast("string"), kind)).first()[0] == shown


def test_drift(spark):
    old = spark.createDataFrame([(1, "a")], "x int, y string")
    new = spark.createDataFrame([(3.0, 1)], "x double, z int")
    found = {r["column"]: r["change"] for r in drift(old, new).collect()}
    assert found == {"x": "type_changed", "y": "removed", "z": "added"}


def test_summary_and_overview(tables):
    facts, figures, results = summary(tables.orders)
    row = figures.first()
    assert row["title"] == "o_totalprice" and row["data_quality"] == 100.0
    assert row["total_rows"] == tables.orders.count() and facts.count() == 6
    assert {r[0] for r in results.select("result").distinct().collect()} == {
        "trend", "breakdown", "share", "histogram", "scatter"}
    averaged = overview(tables.orders.select(F.col("o_totalprice").alias("score"), "o_orderstatus"))
    counts = averaged.filter("result = 'share'").agg(F.sum("value")).first()[0]
    assert counts == tables.orders.count()


def test_tiled_correlation_equals_expressions_and_reaches_300_columns(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tallyloom.operators import quality

    monkeypatch.setattr(quality, "TILE", 3)  # several tiles, uneven last one
    df = spark.range(500).select(
        (F.col("id") % 7).cast("double").alias("a"),
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") * 2.5).alias("b"),
        F.lit(4.0).alias("flat"),
        F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.sin("id")).alias("nan"),
        F.when(F.col("id") < 2, F.col("id")).alias("two"),
        F.lit(None).cast("double").alias("empty"), (F.col("id") * -1.0).alias("down"))
    plain = df.withColumn("nan", F.when(~F.isnan("nan"), F.col("nan")))
    tiled = sorted(map(tuple, quality.correlation_matrix(df, df.columns).collect()))
    by_expressions = sorted(map(tuple, quality.correlation_matrix_by_expressions(plain, df.columns).collect()))
    assert len(tiled) == 49
    # a constant column correlates with nothing (the expressions' rounding leaves -0.03 against "nan")
    assert all(r == 0.0 for a, b, r in tiled if "flat" in (a, b))
    assert [t for t in tiled if "flat" not in t[:2]] == [t for t in by_expressions if "flat" not in t[:2]]
    wide = spark.range(300).select(*[(F.col("id") * (k + 1) % 13).cast("double").alias(f"c{k}") for k in range(300)])
    assert quality.correlation_matrix(wide).count() == 300 * 300


def test_kept_profiles_count_exactly_and_measure_shift(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyloom.operators import sketches

    old = spark.range(1000).select(F.col("id").cast("double").alias("x"),
                                   F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") % 7).alias("k"),
                                   (F.col("id") % 3).cast("string").alias("s"))
    new = old.select((F.col("x") + 100).alias("x"), "k", F.lit("a").alias("t"))
    folder = str(tmp_path / "kept")
    assert [sketches.save_profile(sketches.kept_profile(t), folder) for t in (old, new)] == [1, 2]
    first = {r["column"]: r for r in sketches.read_profile(spark, folder, 1).collect()}
    assert (first["x"].unique_count, first["k"].unique_count, first["s"].unique_count) == (1000, 7, 3)
    assert first["k"].missing == 250
    found = {r["column"]: r for r in sketches.drift(sketches.read_profile(spark, folder, 1),
                                                    sketches.read_profile(spark, folder)).collect()}
    assert found["x"].change == "kept" and found["x"].mean_shift == 100.0
    assert abs(found["x"].distance - 100 / 999) < 0.03
    # same values; KLL compaction is random, so a probe may read the next of its 7 values: one step of 6
    assert found["k"].distance <= 1 / 6 + 1e-9 and found["k"].unique_shift == 0
    assert found["s"].change == "removed" and found["t"].change == "added"
