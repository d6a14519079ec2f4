import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast import panel as panels
from shelfcast.functions.ranking import rank_within
from shelfcast.operators import clean, profile, quantiles, validate
from shelfcast.sources import files


def test_round_trips(spark, series, tmp_path):
    df = series([1, 2, None], price=[1.0, 2.0, 3.0], on_promo=[0, 1, 0])
    for fmt in ("csv", "parquet", "json"):
        path = str(tmp_path / f"p.{fmt}")
        files.write_panel(df, path)
        back = files.read_panel(spark, path, schema=df.schema)
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    parts = str(tmp_path / "parts.parquet")
    files.write_panel(df, parts, partition_by=["store_id"])
    assert files.read_panel(spark, parts).where("store_id = 'S1'").count() == 3


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"date":"2023-01-01","sales":1.5},{"date":"2023-01-02","sales":2}]')
    assert files.read_panel(spark, str(tmp_path / "a.json"), json_array=True).count() == 2


def test_reader_errors(spark):
    with pytest.raises(FileNotFoundError):
        files.read_panel(spark, "/nowhere/x.parquet")
    with pytest.raises(ValueError, match="cannot be read"):
        files.read_panel(spark, "/nowhere/x.xlsx")
    with pytest.raises(ValueError, match="no data source"):
        files.load_data(spark, "somewhere")


def test_nan_becomes_null(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    spark.sql("select double('nan') as sales, 1 as k").write.parquet(path)
    assert files.read_panel(spark, path).first().sales is None


def test_directory_of_different_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,store_id,item_id,sales\n2023-01-01,S1,I1,5\n")
    (tmp_path / "b.csv").write_text("store_id,date,item_id,sales,price\nS2,2023-01-02,I1,6,1.5\nS2,2023-01-03,I1,7,1.5\n")
    (tmp_path / "c.csv").write_text("")
    df = files.load_data(spark, directory=str(tmp_path))
    got = {r.store_id: (r.sales, r.price) for r in df.collect()}
    assert df.count() == 3 and got["S1"] == ("5", None) and got["S2"][1] == "1.5"
    assert files.cast_panel(df).schema["sales"].dataType.typeName() == "double"
    with pytest.raises(ValueError):
        files.read_directory(spark, str(tmp_path), "*.parquet")


def test_profile_and_importance_sinks(spark, series, tmp_path):
    df = series([1, None, 3], price=[1.0, 2.0, 3.0], on_promo=[0, 1, 0])
    profile.write_profile(profile.quality_report(df), str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q" / "missingness")).where("column = 'sales'").first().n_null == 1
    imp = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "feature string, importance double")
    files.write_importance(imp, str(tmp_path / "i"))
    assert [r[0] for r in spark.read.csv(str(tmp_path / "i"), header=True).collect()] == ["b", "a"]


def test_duplicates_keep_first(spark):
    d = dt.date(2023, 1, 1)
    df = spark.createDataFrame([(d, "S", "I", 5.0, 2), (d, "S", "I", 9.0, 1), (d, "S", "I", 5.0, 2), (dt.date(2023, 1, 2), "S", "I", 1.0, 3)],
                               "date date, store_id string, item_id string, sales double, line int")
    out = clean.drop_duplicates(df, order_by=["line"])
    assert out.count() == 2 and out.where(F.col("date") == d).first().sales == 9.0


def test_one_hot_key_is_limited_before_the_shuffle(spark):
    store = F.when(F.col("id") % 3 == 0, "S").otherwise("T")
    df = spark.range(100_000).select(F.lit(dt.date(2023, 1, 1)).alias("date"), store.alias("store_id"), store.alias("item_id"), F.col("id").alias("sales"))
    out = clean.drop_duplicates(df, order_by=["sales"])
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.sales for r in out.collect()) == [0, 1]


def test_outliers_capped(series):
    out = clean.cap_outliers(series([100] * 9 + [1000]))
    assert out.agg(F.max("sales")).first()[0] == 100


def test_gap_fill_spans_all_series(spark, days):
    d = days(10)
    df = spark.createDataFrame([(d[2], "A", "x", 1.0), (d[5], "A", "x", 2.0), (d[0], "B", "x", 3.0), (d[9], "B", "x", 4.0)],
                               "date date, store_id string, item_id string, sales double")
    out = clean.fill_calendar_gaps(df)
    assert out.count() == 20 and out.where("sales is not null").count() == 4
    assert {tuple(r) for r in out.where("sales is not null").collect()} == {tuple(r) for r in df.collect()}
    filled = clean.impute_sales(out).where("store_id = 'A'").orderBy("date").collect()
    assert [r.sales for r in filled] == [1.0] * 5 + [2.0] * 5


def test_gap_fill_keeps_repeated_days(spark, days):
    d = days(3)
    df = spark.createDataFrame([(d[0], "A", "x", 1.0), (d[0], "A", "x", 2.0), (d[2], "A", "x", 3.0)], "date date, store_id string, item_id string, sales double")
    assert clean.fill_calendar_gaps(df).count() == 4


def test_clean_flags(series):
    df = series([10, 11, 12, 11, 10, 500, 11], price=[1.0] * 7, on_promo=[0] * 7, temperature=[1.0] * 7, precipitation=[0.0] * 7, holiday_name=[""] * 7)
    out = clean.clean(df.withColumn("date", F.col("date").cast("string")))
    assert out.where("is_outlier").count() == 1 and out.agg(F.max("sales")).first()[0] < 500
    assert out.where("is_missing").isEmpty()
    total = {r.metric: r.value for r in clean.cleaning_summary(df, out).collect()}
    assert total["rows_removed"] == 0 and total["is_outlier_flagged"] == 1


def test_validation(spark, series):
    df = series([1, 2], price=[1.0, 1.0], on_promo=[0, 1])
    validate.validate_raw(df)
    validate.validate_clean(df, strict=True)
    assert validate.validate_series(panels.Panel(df))
    assert not validate.validate_series(panels.Panel(df.drop("sales")))
    assert not validate.validate_series(panels.Panel(df.union(df)))
    with pytest.raises(ValueError, match="negative"):
        validate.validate_raw(df.withColumn("sales", F.lit(-1.0)))
    for promo in (F.lit(2), F.lit(None).cast("int")):
        with pytest.raises(ValueError, match="0 or 1"):
            validate.validate_raw(df.withColumn("on_promo", promo))
    validate.validate_clean(df.withColumn("on_promo", F.lit(None).cast("int")))
    with pytest.raises(ValueError, match="0 or 1"):
        validate.validate_clean(df.withColumn("on_promo", F.lit(None).cast("int")), strict=True)
    with pytest.raises(ValueError, match="not numbers"):
        validate.validate_raw(df.withColumn("sales", F.lit("not_a_number")))
    with pytest.raises(ValueError, match="not dates"):
        validate.require_columns(df.withColumn("date", F.lit("invalid_date")), ["sales"], ["date"])
    with pytest.raises(ValueError, match="lacks the columns"):
        validate.require_columns(df, ["nothing"])
    with pytest.raises(ValueError, match="leakage"):
        validate.assert_chronological(df, df)


def test_requests(spark):
    rows = [("ok", "2024-01-01", "2024-01-07", [0, 1], [9.0]), ("promo", "2024-01-01", "2024-01-07", [2], None), ("price", "2024-01-01", "2024-01-07", None, [-5.0]),
            ("order", "2024-01-07", "2024-01-01", None, None), ("long", "2024-01-01", "2025-01-01", None, None)]
    df = spark.createDataFrame(rows, "item_id string, a string, b string, promo_plan array<int>, price_plan array<double>")
    out = validate.validate_forecast_requests(df.selectExpr("item_id", "date(a) as start_date", "date(b) as end_date", "promo_plan", "price_plan"))
    assert {r.item_id: len(r.errors) for r in out.collect()} == {"ok": 0, "promo": 1, "price": 1, "order": 1, "long": 1}


def test_quantiles_leave_out_what_is_no_number(spark):
    rows = [(float(i), float(i % 5)) for i in range(5000)] + [(float("nan"), float("inf")), (float("-inf"), None), (None, float("nan"))]
    q = quantiles.exact_quantiles(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], [0.25, 0.75])
    assert q == {"a": [1249.75, 3749.25], "b": [1.0, 3.0]}
    wide = spark.createDataFrame([(v,) for v in (-1.7e308, -5e-324, 0.0, 5e-324, 1.7e308)], "v double")
    assert quantiles.exact_quantiles(wide, ["v"], [0.0, 0.25, 0.5, 0.75, 1.0])["v"] == [-1.7e308, -5e-324, 0.0, 5e-324, 1.7e308]


def test_quantiles(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 1), rng.expovariate(0.001), float(rng.randint(0, 5))]) for _ in range(30_001)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = np.quantile(values, probs)
    assert quantiles.exact_quantiles(df, ["v"], probs)["v"] == pytest.approx(want, rel=1e-12)
    heavy = df.withColumn("v", F.when(F.rand(1) < 0.4, F.lit(2.0)).otherwise(F.col("v"))).persist()
    a = quantiles.exact_quantiles(heavy, ["v"], probs)["v"]
    assert a == pytest.approx(np.quantile([r.v for r in heavy.collect()], probs), rel=1e-12)
    assert quantiles.exact_quantiles(df.where("v > 1e300"), ["v"], probs)["v"] is None


def test_rank_within(spark):
    df = spark.range(5000).select((F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7)).alias("g"), F.xxhash64("id").alias("v"))
    a = {(r.g, r.v): r["rank"] for r in rank_within(df, ["g"], ["v"]).collect()}
    groups = {}
    for g, v in sorted(a):
        groups.setdefault(g, []).append(a[g, v])
    assert len(a) == 5000 and all(ranks == list(range(len(ranks))) for ranks in groups.values())
    whole = sorted((r.v, r["rank"]) for r in rank_within(df, [], ["v"]).collect())
    assert [r for _, r in whole] == list(range(5000))


def test_profiles(series):
    df = series([1, None, None, 4, None, 6], on_promo=[0, 1, 1, 0, 0, 0], price=[1.0] * 6)
    r = profile.missing_runs(df).first()
    assert (r.n_runs, r.n_missing, r.max_run, r.avg_run) == (2, 3, 2, 1.5)
    assert profile.series_completeness(df.where("sales is not null")).first().missing_days == 3
    gone, first = profile.missing_date_summary(df.where("sales is not null"))
    assert gone.first()[0] == 3 and first.count() == 3
    assert profile.column_cardinality(df).where("column = 'sales'").first().n_distinct == 3
    h = profile.value_histogram(df, "sales", 5).orderBy("bin").collect()
    assert sum(x.n for x in h) == 3 and h[-1].bin == 5
    assert profile.overview_kpis(df, "S1", "I1").first().total_sales == 11


def test_splits(series):
    p = panels.Panel(series(range(20), on_promo=[0] * 20))
    train, val, test = panels.split_by_date(p, dt.date(2023, 1, 10), dt.date(2023, 1, 11), dt.date(2023, 1, 16))
    assert (train.df.count(), val.df.count(), test.df.count()) == (10, 5, 5)
    assert panels.split_by_date(p, dt.date(2023, 1, 10), dt.date(2023, 1, 11))[1].df.count() == 9
    assert panels.filter_series(p, [("S1", "I1")]).df.count() == 20
    assert [x.df.count() for x in panels.split_by_series(p, [("S1", "I1")], [], [("S2", "I1")])] == [20, 0, 0]
    assert panels.recent(p.df).count() == 8
    folds = panels.rolling_origin_splits(p, 3, 4)
    assert folds[-1]["val_end"] == dt.date(2023, 1, 20) and folds[0]["train_end"] == dt.date(2023, 1, 8)
    with pytest.raises(ValueError):
        panels.rolling_origin_splits(p, 5, 4)
    df = p.df.withColumns({"flag": F.lit(True), "when": F.col("date")})
    assert panels.feature_columns(df) == ["on_promo", "flag"]
