import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.config import Config
from shelfcast.functions.series import add_ema
from shelfcast.operators.features import calendar, holiday, lag, price_promo, weather
from shelfcast.operators.features.pipeline import FeaturePipeline, build_features

SALES = [80, 100, 84, 96, 88, 60, 72, 90, 81, 99, 77]
PRICE = [20.0, 16.0, 18.0, 15.0, 17.0, 21.0, 19.0, 14.0, 20.0, 16.0, 18.0]
PROMO = [0, 0, 1, 1, 1, 0, 1, 0, 0, 1, 1]


def test_calendar_values(series):
    rows = calendar.add_calendar(series([100] * 10)).orderBy("date").collect()
    assert [r.day_of_week for r in rows[:3]] == [6, 0, 1]
    assert rows[0].is_new_year and rows[0].is_year_start and rows[0].is_weekend and rows[0].is_winter
    assert rows[0].week_of_year == 52 and rows[1].week_of_year == 1
    assert rows[7].week_of_month == 2 and rows[0].daily_sin == 0.0 and rows[0].daily_cos == 1.0


def test_holidays_and_distances(series):
    rows = holiday.add_holidays(series([1] * 20)).orderBy("date").collect()
    assert rows[0].holiday_holiday_name == "New Year's Day"
    assert rows[1].holiday_holiday_name == "New Year's Day (observed)"
    assert rows[15].holiday_holiday_name == "Martin Luther King Jr. Day"
    assert rows[2].holiday_days_to_holiday == 13 and rows[2].holiday_days_from_holiday == 1
    assert rows[0].holiday_days_to_holiday == 1 and rows[0].holiday_days_from_holiday == 6


def test_holidays_of_any_year(spark):
    days = ["1820-01-01", "1869-12-31", "1940-07-04", "1965-05-30", "1965-05-31", "1965-11-11", "2110-12-25", "2823-07-04", "9998-12-25"]
    df = spark.createDataFrame([(d,) for d in days], "d string").selectExpr("date(d) as date")
    rows = holiday.add_holidays(df).orderBy("date").collect()
    names = ["", "", "Independence Day", "Memorial Day", "Memorial Day (observed)", "Veterans Day", "Christmas Day", "Independence Day", "Christmas Day"]
    assert [r.holiday_holiday_name or "" for r in rows] == names
    assert rows[0].holiday_days_to_holiday == 18_263 and rows[1].holiday_days_to_holiday == 1 and rows[0].holiday_days_from_holiday == 365
    assert [r.holiday_days_from_holiday for r in rows[2:4]] == [35, 97]
    own = spark.sql("select date'2105-03-03' as date, 'Fair' as name union all select date'1700-01-01', 'Old'")
    rows = holiday.add_holidays(df, own).orderBy("date").collect()
    assert rows[6].holiday_days_from_holiday == 2123 and rows[6].holiday_days_to_holiday == 365 and rows[0].holiday_days_from_holiday == 43_828
    assert holiday.add_holidays(spark.sql("select date'2105-03-03' as date"), own).first().holiday_holiday_name == "Fair"


def test_distance_without_holidays_on_a_side(spark, series):
    own = spark.sql("select date'2023-01-05' as date, 'Fair' as name")
    rows = holiday.add_holidays(series([1] * 10), own).orderBy("date").collect()
    assert rows[0].holiday_days_to_holiday == 4 and rows[0].holiday_days_from_holiday == 365
    assert rows[4].holiday_is_holiday and rows[4].holiday_days_to_holiday == 365
    assert rows[9].holiday_days_from_holiday == 5


def test_lags_respect_max_lag(series):
    out = lag.add_lag_features(series(range(100, 120)), max_lag=7, windows=[3, 7])
    assert {"sales_lag_1", "sales_lag_7", "sales_rolling_mean_3", "sales_ema_3"} <= set(out.columns)
    assert "sales_lag_14" not in out.columns
    rows = out.orderBy("date").collect()
    assert rows[0].sales_lag_1 is None and rows[7].sales_lag_7 == 100 and rows[2].sales_rolling_median_3 == 101
    assert rows[0].sales_rolling_std_3 is None and rows[2].sales_diff_2 == 2


def random_panel(spark, seed=0, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for s, share in (("a", 0.0), ("b", 0.15), ("c", 0.7)):
        for i in range(n):
            gone = rng.random() < share
            rows.append((pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=i), s, "x", None if gone else float(rng.normal(50, 20)),
                         None if gone else float(rng.uniform(1, 9))))
    return spark.createDataFrame(rows, "date date, store_id string, item_id string, sales double, price double")


def by_series(df):
    return df.toPandas().sort_values(["store_id", "date"]).reset_index(drop=True)


def test_ema_equals_pandas(spark):
    df = add_ema(random_panel(spark), "sales", "e", 0.3, adjust=False)
    df = add_ema(df, "sales", "f", 2 / 15, adjust=True, shift=1)
    p = by_series(df)
    g = p.groupby("store_id").sales
    pd.testing.assert_series_equal(p.e, g.transform(lambda v: v.ewm(alpha=0.3, adjust=False).mean()), check_names=False, rtol=1e-11)
    pd.testing.assert_series_equal(p.f, g.transform(lambda v: v.ewm(span=14).mean().shift(1)), check_names=False, rtol=1e-11)


def test_rolling_and_change_equal_pandas(spark):
    p = by_series(price_promo.add_price_promo(lag.add_lag_features(random_panel(spark, 1))))
    g = p.groupby("store_id")
    for n in (7, 28):
        for stat in ("mean", "std", "median"):
            want = g.sales.transform(lambda v: getattr(v.rolling(n, min_periods=1), stat)())
            pd.testing.assert_series_equal(p[f"sales_rolling_{stat}_{n}"], want, check_names=False, rtol=1e-9)
    want = g.price.transform(lambda v: v.ffill() / v.ffill().shift(1) - 1)
    pd.testing.assert_series_equal(p.price_pct_change, want, check_names=False, rtol=1e-9)


def test_price_and_promo(series):
    out = price_promo.add_price_promo(series(SALES, price=PRICE, on_promo=PROMO)).orderBy("date").toPandas()
    assert out.days_since_last_promo.tolist() == [0, 1, 0, 1, 2, 0, 0, 0, 1, 0, 1]
    assert out.days_until_next_promo.tolist() == [1, 0, 2, 1, 0, 0, 0, 1, 0, 1, 0]
    assert out.promo_intensity.tolist() == [0, 0, 1, 2, 3, 0, 1, 0, 0, 1, 2]
    assert out.price_pct_change[1] == pytest.approx(-0.2)
    assert out.price_elasticity[1] == pytest.approx(0.25 / -0.2)
    assert out.price_percentile_7[0] == 0.5 and out.price_trend[0] == 0.0
    assert out.price_trend[6] == pytest.approx(np.polyfit(range(7), PRICE[:7], 1)[0])
    assert out.promo_cannibalization[0] == 0 and out.promo_cannibalization[4] == pytest.approx(out.promo_sales_lift[5])
    assert not np.isinf(out.select_dtypes("number").to_numpy(dtype=float)).any()


def test_null_promo_is_a_run_of_its_own(series):
    out = price_promo.add_price_promo(series([1] * 5, on_promo=[1, None, None, 0, 0])).orderBy("date").toPandas()
    assert out.days_since_last_promo.tolist() == [0, 0, 0, 0, 1]


def test_weather_edges(series):
    temps = [0.0, 10.0, 20.0, 30.0, 31.0, -1.0, 5.0]
    rain = [0.0, 0.1, 2.5, 10.0, 25.0, 26.0, 0.0]
    out = weather.add_weather(series([1] * 7, temperature=temps, precipitation=rain)).orderBy("date").toPandas()
    assert out.temp_category.tolist() == ["very_cold", "cold", "mild", "warm", "hot", "very_cold", "cold"]
    assert out.is_cold.tolist() == [True, False, False, False, False, False, True]
    assert out.precip_category.tolist() == [None, "none", "light", "moderate", "heavy", "extreme", None]
    assert out.dry_spell_duration.tolist() == [0, 0, 0, 0, 0, 0, 1]
    assert out.wet_spell_duration.tolist() == [0, 1, 2, 3, 4, 5, 0]
    assert out.temp_trend[0] == 0.0


def test_safe_features_never_see_the_same_day(series):
    a = lag.add_safe_lag_features(series(range(1, 31))).orderBy("date").toPandas()
    b = lag.add_safe_lag_features(series([*range(1, 30), 9999])).orderBy("date").toPandas()
    new = [c for c in a.columns if c.startswith("sales_")]
    pd.testing.assert_frame_equal(a[new], b[new])
    assert a.loc[0, new].isna().all()
    assert a.sales_rolling_mean_7[3] == 2.0


def test_build_features_adds_flags_and_families(series):
    df = series(range(100, 130), price=[10.0] * 30, on_promo=[0] * 30, temperature=[5.0] * 30, precipitation=[0.0] * 30)
    out = build_features(df, Config(include_weather=True), as_of="2024-01-01", check=True)
    row = out.first()
    assert row.feature_engineered and row.feature_count == len(out.columns) - 1
    assert out.count() == 30
    assert {"day_of_week", "sales_lag_1", "price_trend", "temp_category", "holiday_is_holiday"} <= set(out.columns)


def test_families_together_equal_families_alone(spark):
    p = random_panel(spark, 2, 120).withColumn("on_promo", (F.col("price") > 6).cast("int"))
    both = by_series(build_features(p, Config(include_calendar=False), as_of="2024-01-01"))
    alone = by_series(price_promo.add_price_promo(lag.add_lag_features(p)))
    pd.testing.assert_frame_equal(both[list(alone.columns)], alone)


def test_plan_has_one_shuffle(spark):
    p = random_panel(spark, 3, 30).withColumn("on_promo", (F.col("price") > 6).cast("int"))
    out = build_features(p, Config(include_calendar=False), as_of="2024-01-01")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_pipeline_needs_fit_and_keys(series):
    df = series(range(20), price=[1.0] * 20, on_promo=[0] * 20)
    pipe = FeaturePipeline()
    with pytest.raises(ValueError, match="call fit"):
        pipe.transform(df)
    with pytest.raises(ValueError, match="need the columns"):
        pipe.fit(df.drop("store_id"))
    out = pipe.fit_transform(df)
    assert pipe.is_fitted and set(pipe.feature_columns()) <= set(out.columns)


def test_pipeline_encodes_unseen_as_first(series):
    cold = series([1] * 5, temperature=[5.0, 5.0, 15.0, 15.0, 5.0], precipitation=[1.0] * 5)
    hot = series([1] * 5, temperature=[35.0, 5.0, 15.0, 5.0, 5.0], precipitation=[1.0] * 5)
    pipe = FeaturePipeline(Config(include_weather=True, include_calendar=False)).fit(cold)
    codes = [r.temp_category for r in pipe.transform(hot).orderBy("date").collect()]
    assert codes == [0, 0, 1, 0, 0]  # cold -> 0, mild -> 1, hot unseen
