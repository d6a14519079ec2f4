"""Calendar, holiday, lag, price, promotion and weather features, encoding and the feature pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import FILLED, K, OFFSET, PANEL, SQL, W, filled_of, panel_of, preceding, query, tidy_sql, trailing
from shelfcast.config import Config
from shelfcast.functions.series import add_ema
from shelfcast.functions.series import series_window
from shelfcast.operators.features import calendar, holiday, lag, pipeline, price_promo, weather

KEY = ["date", "store_id", "item_id"]
KEYS_SQL = f"date, {K}"


# --- calendar -------------------------------------------------------------------------------

PARTS = """
CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(weekofyear(date) AS INTEGER) AS week_of_year,
CAST((day(date) - 1) // 7 + 1 AS INTEGER) AS week_of_month, CAST(month(date) AS INTEGER) AS month,
CAST(quarter(date) AS INTEGER) AS quarter, CAST(year(date) AS INTEGER) AS year,
day(date) = 1 AS is_month_start, date = last_day(date) AS is_month_end,
day(date) = 1 AND month(date) IN (1, 4, 7, 10) AS is_quarter_start,
date = last_day(date) AND month(date) IN (3, 6, 9, 12) AS is_quarter_end,
dayofyear(date) = 1 AS is_year_start, month(date) = 12 AND day(date) = 31 AS is_year_end,
isodow(date) >= 6 AS is_weekend, isodow(date) <= 5 AS is_working_day"""


@query("calendar_basic", f"WITH {PANEL} --result\nSELECT {KEYS_SQL}, {PARTS} FROM panel", dates=["date"])
def _(spark, folder):
    p = panel_of(spark, folder).select(*KEY)
    return p.withColumns(calendar.date_parts())


SPECIAL = ", ".join(
    f"month(date) = {m} AND day(date) BETWEEN {a} AND {b} AS {n}" for n, (m, a, b) in calendar.SPECIAL_DAYS.items()
)


@query(
    "holiday_flags",
    f"""WITH {PANEL} --result
    SELECT {KEYS_SQL}, {SPECIAL}, month(date) IN (3, 4, 5) AS is_spring, month(date) IN (6, 7, 8) AS is_summer,
      month(date) IN (9, 10, 11) AS is_fall, month(date) IN (12, 1, 2) AS is_winter FROM panel""",
    dates=["date"],
)
def _(spark, folder):
    p = panel_of(spark, folder).select(*KEY)
    return p.withColumns({**calendar.special_days(), **calendar.seasons()})


CYCLES = {"annual": "dayofyear(date) / CAST(365.25 AS DOUBLE)", "monthly": "month(date) / CAST(12 AS DOUBLE)",
          "weekly": "(isodow(date) - 1) / CAST(7 AS DOUBLE)", "daily": "CAST(0 AS DOUBLE)"}


@query(
    "cyclical",
    f"""WITH {PANEL} --result
    SELECT {KEYS_SQL}, {', '.join(f"{f}(2 * pi() * ({t})) AS {n}_{f}" for n, t in CYCLES.items() for f in ("sin", "cos"))} FROM panel""",
    [f"{n}_{f}" for n in CYCLES for f in ("sin", "cos")],
    ["date"],
)
def _(spark, folder):
    return panel_of(spark, folder).select(*KEY).withColumns(calendar.cyclical())


# --- holidays -------------------------------------------------------------------------------

HOLIDAYS = """
years AS (SELECT CAST(y AS INTEGER) AS y FROM range(1949, 2102) t(y)),
fixed AS (
  SELECT name, make_date(y, m, d) AS date FROM years, (VALUES ('New Year''s Day', 1, 1, 1870), ('Juneteenth National Independence Day', 6, 19, 2021),
    ('Independence Day', 7, 4, 1870), ('Veterans Day', 11, 11, 1978), ('Christmas Day', 12, 25, 1870)) r(name, m, d, since) WHERE y >= since),
moving AS (
  SELECT name, CASE WHEN n > 0
      THEN make_date(y, m, 1) + CAST((dow - isodow(make_date(y, m, 1)) + 7) % 7 + 7 * (n - 1) AS INTEGER)
      ELSE last_day(make_date(y, m, 1)) - CAST((isodow(last_day(make_date(y, m, 1))) - dow + 7) % 7 AS INTEGER) END AS date
  FROM years, (VALUES ('Martin Luther King Jr. Day', 1, 1, 3, 1986), ('Washington''s Birthday', 2, 1, 3, 1971), ('Memorial Day', 5, 1, -1, 1971),
    ('Labor Day', 9, 1, 1, 1894), ('Columbus Day', 10, 1, 2, 1971), ('Thanksgiving Day', 11, 4, 4, 1942)) r(name, m, dow, n, since) WHERE y >= since),
days AS (
  SELECT name, date FROM fixed UNION ALL SELECT name, date FROM moving
  UNION ALL SELECT name || ' (observed)', date - 1 FROM fixed WHERE isodow(date) = 6
  UNION ALL SELECT name || ' (observed)', date + 1 FROM fixed WHERE isodow(date) = 7),
holidays AS (SELECT CAST(date AS DATE) AS date, string_agg(DISTINCT name, '; ' ORDER BY name) AS name FROM days WHERE year(date) BETWEEN 1950 AND 2100 GROUP BY date)"""


@query(
    "holiday_dimension",
    f"WITH {PANEL}, {HOLIDAYS} --result\nSELECT date, name FROM holidays WHERE date BETWEEN (SELECT min(date) FROM panel) AND (SELECT max(date) FROM panel)",
    dates=["date"],
)
def _(spark, folder):
    span = panel_of(spark, folder).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return holiday.holidays_between(holiday.us_holidays(spark), span.select("a").scalar(), span.select("b").scalar())


@query(
    "holiday_join",
    f"""WITH {PANEL}, {HOLIDAYS} --result
    SELECT p.date, store_id, item_id, name IS NOT NULL AS holiday_is_holiday, name AS holiday_holiday_name FROM panel p LEFT JOIN holidays h ON h.date = p.date""",
    dates=["date"],
)
def _(spark, folder):
    return holiday.add_holidays(panel_of(spark, folder).select(*KEY)).drop("holiday_days_to_holiday", "holiday_days_from_holiday")


@query(
    "holiday_distance",
    f"""WITH {PANEL}, {HOLIDAYS},
    near AS (SELECT d.date, min(h.date) FILTER (WHERE h.date > d.date) AS next, max(h.date) FILTER (WHERE h.date < d.date) AS prev
             FROM (SELECT DISTINCT date FROM panel) d CROSS JOIN holidays h GROUP BY d.date) --result
    SELECT p.date, store_id, item_id, CAST(coalesce(date_diff('day', p.date, next), 365) AS INTEGER) AS holiday_days_to_holiday,
      CAST(coalesce(date_diff('day', prev, p.date), 365) AS INTEGER) AS holiday_days_from_holiday FROM panel p JOIN near USING (date)""",
    dates=["date"],
)
def _(spark, folder):
    return holiday.add_holidays(panel_of(spark, folder).select(*KEY)).drop("holiday_is_holiday", "holiday_holiday_name")


# --- lags -----------------------------------------------------------------------------------

LAG_COLS = [f"sales_lag_{n}" for n in lag.LAGS] + [f"sales_diff_{n}" for n in lag.DIFFS]


@query(
    "lags_diffs",
    f"""WITH {FILLED} --result
    SELECT {KEYS_SQL}, {', '.join(f"lag(sales, {n}) OVER ({W}) AS sales_lag_{n}" for n in lag.LAGS)},
      {', '.join(f"sales - lag(sales, {n}) OVER ({W}) AS sales_diff_{n}" for n in lag.DIFFS)} FROM filled""",
    LAG_COLS,
    ["date"],
)
def _(spark, folder):
    w = series_window()
    return filled_of(spark, folder).withColumns({**lag.lag_columns("sales", w), **lag.diff_columns("sales", w)}).select(*KEY, *LAG_COLS)


STATS = {"mean": "avg(sales)", "std": "stddev_samp(sales)", "min": "min(sales)", "max": "max(sales)"}
ROLLING = [f"sales_rolling_{s}_{n}" for n in (7, 14, 28) for s in STATS]


@query(
    "rolling_stats",
    f"""WITH {FILLED} --result
    SELECT {KEYS_SQL}, {', '.join(f"{e} OVER {trailing(n)} AS sales_rolling_{s}_{n}" for n in (7, 14, 28) for s, e in STATS.items())} FROM filled""",
    ROLLING,
    ["date"],
)
def _(spark, folder):
    cols = lag.rolling_columns("sales", series_window(), median=False)
    return filled_of(spark, folder).withColumns(cols).select(*KEY, *cols)


MEDIANS = [f"sales_rolling_median_{n}" for n in (7, 14, 28)]


@query(
    "rolling_median",
    f"""WITH {FILLED} --result
    SELECT {KEYS_SQL}, {', '.join(f"quantile_cont(sales, 0.5) OVER {trailing(n)} AS sales_rolling_median_{n}" for n in (7, 14, 28))} FROM filled""",
    MEDIANS,
    ["date"],
)
def _(spark, folder):
    cols = {k: v for k, v in lag.rolling_columns("sales", series_window()).items() if k in MEDIANS}
    return filled_of(spark, folder).withColumns(cols).select(*KEY, *cols)


@query(
    "ema",
    f"""WITH RECURSIVE {FILLED},
    o AS (SELECT {KEYS_SQL}, sales, row_number() OVER ({W}) AS rn FROM filled),
    e AS (
      SELECT date, store_id, item_id, rn, sales AS level, CAST(1 AS DOUBLE) AS w FROM o WHERE rn = 1
      UNION ALL
      SELECT o.date, o.store_id, o.item_id, o.rn,
        CASE WHEN o.sales IS NULL THEN e.level WHEN e.level IS NULL THEN o.sales
             ELSE (e.w * 0.7::DOUBLE * e.level + 0.3::DOUBLE * o.sales) / (e.w * 0.7::DOUBLE + 0.3::DOUBLE) END,
        CASE WHEN e.level IS NULL OR o.sales IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE e.w * 0.7::DOUBLE END
      FROM e JOIN o ON o.store_id = e.store_id AND o.item_id = e.item_id AND o.rn = e.rn + 1)
    --result
    SELECT {KEYS_SQL}, level AS sales_ema_3 FROM e""",
    ["sales_ema_3"],
    ["date"],
)
def _(spark, folder):
    return add_ema(filled_of(spark, folder).select(*KEY, "sales"), "sales", "sales_ema_3", 0.3, adjust=False).drop("sales")


@query(
    "ema_span_safe",
    f"""WITH {FILLED}, o AS (SELECT *, row_number() OVER ({W}) AS rn FROM filled) --result
    SELECT {KEYS_SQL}, sum(sales * pow(13.0::DOUBLE / 15, -rn)) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      / sum(CASE WHEN sales IS NOT NULL THEN pow(13.0::DOUBLE / 15, -rn) END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sales_ema_14 FROM o""",
    ["sales_ema_14"],
    ["date"],
)
def _(spark, folder):
    return add_ema(filled_of(spark, folder).select(*KEY, "sales"), "sales", "sales_ema_14", 2 / 15, adjust=True, shift=1).drop("sales")


SAFE = [f"sales_lag_{n}" for n in lag.LAGS] + [f"sales_rolling_{s}_{n}" for n in (7, 14, 28) for s in ("mean", "std")]


@query(
    "leakage_safe",
    f"""WITH {FILLED} --result
    SELECT {KEYS_SQL}, {', '.join(f"lag(sales, {n}) OVER ({W}) AS sales_lag_{n}" for n in lag.LAGS)},
      {', '.join(f"{STATS[s]} OVER {preceding(n)} AS sales_rolling_{s}_{n}" for n in (7, 14, 28) for s in ("mean", "std"))},
      lag(on_promo) OVER ({W}) AS promo_lag_1, CAST(sum(on_promo) OVER {preceding(7)} AS BIGINT) AS promo_rolling_7 FROM filled""",
    SAFE,
    ["date"],
)
def _(spark, folder):
    f = filled_of(spark, folder)
    cols = lag.safe_columns(f.columns, "sales", series_window())
    return f.withColumns(cols).select(*KEY, *cols)


# --- price and promotion --------------------------------------------------------------------

RUNS = f"""
marked AS (SELECT *, CASE WHEN on_promo = lag(on_promo) OVER ({W}) THEN 0 ELSE 1 END AS starts FROM filled),
runs AS (SELECT *, sum(starts) OVER ({W}) AS run FROM marked),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY {K}, run ORDER BY date) - 1 AS INTEGER) AS since,
           CAST(row_number() OVER (PARTITION BY {K}, run ORDER BY date DESC) - 1 AS INTEGER) AS until FROM runs)"""


@query(
    "promo_runs",
    f"""WITH {FILLED}, {RUNS} --result
    SELECT {KEYS_SQL}, since AS days_since_last_promo, until AS days_until_next_promo, since AS promo_duration,
      CAST(sum(on_promo) OVER (PARTITION BY {K}, run ORDER BY date) AS INTEGER) AS promo_intensity FROM placed""",
    dates=["date"],
)
def _(spark, folder):
    out = price_promo.add_price_promo(filled_of(spark, folder).select(*KEY, "on_promo"))
    return out.select(*KEY, "days_since_last_promo", "days_until_next_promo", "promo_duration", "promo_intensity")


@query(
    "promo_rolling",
    f"""WITH {FILLED} --result
    SELECT {KEYS_SQL}, {', '.join(f"CAST(sum(on_promo) OVER {trailing(n)} AS BIGINT) AS on_promo_rolling_{n}, avg(on_promo) OVER {trailing(n)} AS on_promo_frequency_{n}" for n in (7, 14, 28))} FROM filled""",
    [f"on_promo_frequency_{n}" for n in (7, 14, 28)],
    ["date"],
)
def _(spark, folder):
    out = price_promo.add_price_promo(filled_of(spark, folder).select(*KEY, "on_promo"))
    return out.select(*KEY, *[f"on_promo_{s}_{n}" for n in (7, 14, 28) for s in ("rolling", "frequency")])


@query(
    "promo_lag_features",
    f"""WITH {FILLED}, {RUNS} --result
    SELECT {KEYS_SQL}, {', '.join(f"CAST(sum(on_promo) OVER {trailing(n)} AS BIGINT) AS on_promo_rolling_{n}" for n in (7, 14, 28))},
      since AS days_since_last_promo, until AS days_until_next_promo FROM placed""",
    dates=["date"],
)
def _(spark, folder):
    return lag.add_promo_lag_features(filled_of(spark, folder).select(*KEY, "on_promo")).drop("on_promo")


def pct(c: str) -> str:
    return (f"(last_value({c} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING)"
            f" / nullif(last_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1)")


PRICE = ["price_pct_change", "price_diff"] + [f"price_{s}_{n}" for n in (7, 14, 28) for s in ("rolling_mean", "rolling_std", "volatility", "percentile")]


@query(
    "price_features",
    f"""WITH {FILLED} --result
    SELECT {KEYS_SQL}, {pct('price')} AS price_pct_change, price - lag(price) OVER ({W}) AS price_diff,
      {', '.join(f'''avg(price) OVER {trailing(n)} AS price_rolling_mean_{n}, stddev_samp(price) OVER {trailing(n)} AS price_rolling_std_{n},
        stddev_samp(price) OVER {trailing(n)} / avg(price) OVER {trailing(n)} AS price_volatility_{n},
        CASE WHEN max(price) OVER {trailing(n)} = min(price) OVER {trailing(n)} THEN 0.5
             ELSE (price - min(price) OVER {trailing(n)}) / (max(price) OVER {trailing(n)} - min(price) OVER {trailing(n)}) END AS price_percentile_{n}''' for n in (7, 14, 28))}
    FROM filled""",
    PRICE,
    ["date"],
    digits=5,
)
def _(spark, folder):
    return price_promo.add_price_promo(filled_of(spark, folder).select(*KEY, "price")).select(*KEY, *PRICE)


def slope_sql(c: str) -> str:
    f = trailing(7)
    return (f"CASE WHEN count({c}) OVER {f} = 0 THEN NULL WHEN count(*) OVER {f} < 2 OR count({c}) OVER {f} < count(*) OVER {f} THEN 0.0"
            f" ELSE regr_slope({c}, rn) OVER {f} END")


@query(
    "price_trend",
    f"""WITH {FILLED}, o AS (SELECT *, row_number() OVER ({W}) AS rn FROM filled) --result
    SELECT {KEYS_SQL}, {slope_sql('price')} AS price_trend FROM o""",
    ["price_trend"],
    ["date"],
    digits=5,
)
def _(spark, folder):
    return price_promo.add_price_promo(filled_of(spark, folder).select(*KEY, "price")).select(*KEY, "price_trend")


ELASTIC = ["price_elasticity", "price_elasticity_rolling_14", "price_elasticity_rolling_28", "price_sensitivity"]


@query(
    "elasticity",
    f"""WITH {FILLED}, e AS (SELECT *, {pct('sales')} / nullif({pct('price')}, 0) AS price_elasticity FROM filled) --result
    SELECT {KEYS_SQL}, price_elasticity, avg(price_elasticity) OVER {trailing(14)} AS price_elasticity_rolling_14,
      avg(price_elasticity) OVER {trailing(28)} AS price_elasticity_rolling_28, stddev_samp(price_elasticity) OVER {trailing(28)} AS price_sensitivity FROM e""",
    ELASTIC,
    ["date"],
    digits=3,
)
def _(spark, folder):
    return price_promo.add_price_promo(filled_of(spark, folder).select(*KEY, "price", "sales")).select(*KEY, *ELASTIC)


LIFT = ["baseline_sales", "promo_sales_lift", "promo_effectiveness_14", "promo_effectiveness_28", "promo_cannibalization"]


@query(
    "promo_lift",
    f"""WITH {FILLED}, b AS (SELECT *, avg(sales) OVER {trailing(14)} AS baseline_sales FROM filled),
    l AS (SELECT *, (sales - baseline_sales) / nullif(baseline_sales, 0) AS promo_sales_lift FROM b) --result
    SELECT {KEYS_SQL}, baseline_sales, promo_sales_lift, avg(promo_sales_lift) OVER {trailing(14)} AS promo_effectiveness_14,
      avg(promo_sales_lift) OVER {trailing(28)} AS promo_effectiveness_28,
      CASE WHEN on_promo = 1 THEN lead(promo_sales_lift) OVER ({W}) ELSE 0.0 END AS promo_cannibalization FROM l""",
    LIFT,
    ["date"],
)
def _(spark, folder):
    return price_promo.add_price_promo(filled_of(spark, folder).select(*KEY, "on_promo", "sales")).select(*KEY, *LIFT)


# --- weather --------------------------------------------------------------------------------

TEMP = ["temp_change", "temp_change_abs", "temp_trend", "temp_seasonal_deviation"] + [f"temp_rolling_{s}_{n}" for n in (3, 7, 14) for s in ("mean", "range", "std")] + [f"temp_lag_{n}" for n in (1, 3, 7)]
TEMP_FLAGS = ["temp_category", "is_very_cold", "is_cold", "is_mild", "is_warm", "is_hot"]


@query(
    "weather_temp",
    f"""WITH {FILLED}, o AS (SELECT *, temperature AS t, row_number() OVER ({W}) AS rn FROM filled) --result
    SELECT {KEYS_SQL}, CASE WHEN t IS NULL THEN NULL WHEN t <= 0 THEN 'very_cold' WHEN t <= 10 THEN 'cold' WHEN t <= 20 THEN 'mild' WHEN t <= 30 THEN 'warm' ELSE 'hot' END AS temp_category,
      coalesce(t < 0, false) AS is_very_cold, coalesce(t >= 0 AND t < 10, false) AS is_cold, coalesce(t >= 10 AND t < 20, false) AS is_mild,
      coalesce(t >= 20 AND t < 30, false) AS is_warm, coalesce(t >= 30, false) AS is_hot,
      t - lag(t) OVER ({W}) AS temp_change, abs(t - lag(t) OVER ({W})) AS temp_change_abs,
      {slope_sql('t')} AS temp_trend, t - avg(t) OVER {trailing(365)} AS temp_seasonal_deviation,
      {', '.join(f"avg(t) OVER {trailing(n)} AS temp_rolling_mean_{n}, max(t) OVER {trailing(n)} - min(t) OVER {trailing(n)} AS temp_rolling_range_{n}, stddev_samp(t) OVER {trailing(n)} AS temp_rolling_std_{n}" for n in (3, 7, 14))},
      {', '.join(f"lag(t, {n}) OVER ({W}) AS temp_lag_{n}" for n in (1, 3, 7))} FROM o""",
    TEMP,
    ["date"],
)
def _(spark, folder):
    f = filled_of(spark, folder).select(*KEY, "temperature")
    return weather.add_weather(f, keys=("store_id", "item_id")).select(*KEY, *TEMP, *TEMP_FLAGS)


RAIN = ["precip_change"] + [f"precip_rolling_{s}_{n}" for n in (3, 7, 14) for s in ("mean", "total", "max")] + [f"precip_lag_{n}" for n in (1, 3, 7)]
RAIN_FLAGS = ["precip_category", "is_dry", "is_light_rain", "is_moderate_rain", "is_heavy_rain", "is_extreme_rain", "dry_spell_duration", "wet_spell_duration"]


@query(
    "weather_precip",
    f"""WITH {FILLED}, o AS (SELECT *, precipitation AS p, sum(CASE WHEN precipitation > 0 THEN 1 ELSE 0 END) OVER ({W}) AS dry,
        sum(CASE WHEN precipitation = 0 THEN 1 ELSE 0 END) OVER ({W}) AS wet FROM filled) --result
    SELECT {KEYS_SQL}, CASE WHEN p IS NULL OR p <= 0 THEN NULL WHEN p <= 0.1 THEN 'none' WHEN p <= 2.5 THEN 'light' WHEN p <= 10 THEN 'moderate' WHEN p <= 25 THEN 'heavy' ELSE 'extreme' END AS precip_category,
      coalesce(p = 0, false) AS is_dry, coalesce(p > 0 AND p <= 2.5, false) AS is_light_rain, coalesce(p > 2.5 AND p <= 10, false) AS is_moderate_rain,
      coalesce(p > 10 AND p <= 25, false) AS is_heavy_rain, coalesce(p > 25, false) AS is_extreme_rain, p - lag(p) OVER ({W}) AS precip_change,
      {', '.join(f"avg(p) OVER {trailing(n)} AS precip_rolling_mean_{n}, sum(p) OVER {trailing(n)} AS precip_rolling_total_{n}, max(p) OVER {trailing(n)} AS precip_rolling_max_{n}" for n in (3, 7, 14))},
      {', '.join(f"lag(p, {n}) OVER ({W}) AS precip_lag_{n}" for n in (1, 3, 7))},
      CAST(row_number() OVER (PARTITION BY {K}, dry ORDER BY date) - 1 AS INTEGER) AS dry_spell_duration,
      CAST(row_number() OVER (PARTITION BY {K}, wet ORDER BY date) - 1 AS INTEGER) AS wet_spell_duration FROM o""",
    RAIN,
    ["date"],
)
def _(spark, folder):
    f = filled_of(spark, folder).select(*KEY, "precipitation")
    return weather.add_weather(f, keys=("store_id", "item_id")).select(*KEY, *RAIN, *RAIN_FLAGS)


COMBO = ["weather_comfort", "is_bad_weather", "is_good_weather", "is_extreme_weather", "weather_severity"]


@query(
    "weather_combo",
    f"""WITH {FILLED}, o AS (SELECT *, temperature AS t, precipitation AS p FROM filled) --result
    SELECT {KEYS_SQL}, t * (1 - p / 100) AS weather_comfort, coalesce(t < 10 AND p > 5, false) AS is_bad_weather,
      coalesce(t >= 15 AND t <= 25 AND p < 1, false) AS is_good_weather, coalesce(t < -5 OR t > 35 OR p > 25, false) AS is_extreme_weather,
      abs(t - 20) / 20 + p / 25 AS weather_severity FROM o""",
    ["weather_comfort", "weather_severity"],
    ["date"],
)
def _(spark, folder):
    f = filled_of(spark, folder).select(*KEY, "temperature", "precipitation")
    return weather.add_weather(f, keys=("store_id", "item_id")).select(*KEY, *COMBO)


# --- encoding and pipelines -----------------------------------------------------------------


@query(
    "label_encode",
    f"""WITH {PANEL}, u AS (SELECT DISTINCT item_id FROM panel WHERE date < DATE '1995-06-01' AND item_id <> 'N'),
    d AS (SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS code FROM u) --result
    SELECT p.date, p.store_id, p.item_id, coalesce(code, 0) AS item_code FROM panel p LEFT JOIN d ON d.item_id = p.item_id""",
    dates=["date"],
)
def _(spark, folder):
    # Fitted without one item, so that unseen values occur.
    p = panel_of(spark, folder).select(*KEY).withColumn("item_code", F.col("item_id"))
    known = p.where("date < date'1995-06-01' and item_id <> 'N'")
    return pipeline.encode_labels(p, pipeline.fit_labels(known, ["item_code"]), ["item_code"])


@query(
    "feature_flags",
    f"WITH {PANEL} --result\nSELECT *, true AS feature_engineered, CAST(10 AS INTEGER) AS feature_count FROM panel",
    ["sales", "price", "temperature", "precipitation"],
    ["date"],
)
def _(spark, folder):
    return pipeline.add_feature_flags(panel_of(spark, folder), as_of="2002-01-01").drop("feature_engineering_date")


# --- all families together ------------------------------------------------------------------

FAMILIES = ("calendar_basic", "cyclical", "holiday_join", "holiday_distance", "promo_runs", "promo_rolling", "price_features", "price_trend",
            "elasticity", "promo_lift", "weather_temp", "weather_precip", "weather_combo", "holiday_flags")
PLAIN = (*FAMILIES, "lags_diffs", "rolling_stats", "rolling_median", "ema", "promo_lag_features")
SAFE = (*FAMILIES, "leakage_safe", "ema_span_safe")
FITTED_BEFORE = "2000-01-01"
FEWER = {**dict.fromkeys([*PRICE, "price_trend"], 5), **dict.fromkeys(ELASTIC, 3)}


def over_filled(name: str) -> str:
    """The SQL of a family over the filled calendar."""
    sql = SQL[name]
    return sql if FILLED in sql else sql.replace(PANEL, "@panel").replace("FROM panel", "FROM filled").replace("@panel", FILLED)


def side_by_side(names: tuple[str, ...], more: str) -> str:
    """The columns of all families, each once."""
    base = tidy_sql(f"WITH {FILLED} --result\nSELECT * FROM filled", ["sales", "price", "temperature", "precipitation"], ["date"])
    keys = "date, store_id, item_id"
    twice = {"promo_lag_features": ", days_since_last_promo, days_until_next_promo, on_promo_rolling_7, on_promo_rolling_14, on_promo_rolling_28"}
    columns = ", ".join(f"f{i}.* EXCLUDE ({keys}{twice.get(n, '')})" for i, n in enumerate(names))
    families = " ".join(f"JOIN ({over_filled(n)}) f{i} USING ({keys})" for i, n in enumerate(names))
    return f"SELECT b.*, {columns}, TRUE AS feature_engineered, {more} FROM ({base}) b {families}"


def as_families(df):
    """Doubles cut to the digits with which their family is compared, where these are fewer."""
    return df.withColumns({c: F.floor(F.col(c) * 10.0 ** n + OFFSET) / 10.0 ** n for c, n in FEWER.items() if c in df.columns})


CODED = ("holiday_holiday_name", "temp_category", "precip_category")


def coded_sql() -> str:
    """Labels by their place among the training rows' values; others get 0."""
    codes = ", ".join(f"coalesce({c}_code.code, 0) AS {c}" for c in CODED)
    tables = ", ".join(
        f"{c}_code AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT {c} AS v FROM t WHERE date < '{FITTED_BEFORE}' AND {c} IS NOT NULL))"
        for c in CODED)
    joins = " ".join(f"LEFT JOIN {c}_code ON {c}_code.v = t.{c}" for c in CODED)
    return f"WITH t AS ({side_by_side(SAFE, 'CAST(150 AS INTEGER) AS feature_count')}), {tables} SELECT t.* REPLACE ({codes}) FROM t {joins}"


@query("feature_table", side_by_side(PLAIN, "CAST(160 AS INTEGER) AS feature_count"))
def _(spark, folder):
    out = pipeline.build_features(filled_of(spark, folder), Config(include_weather=True), as_of="2002-01-01")
    return as_families(out.drop("feature_engineering_date"))


@query("feature_pipeline", coded_sql())
def _(spark, folder):
    p = filled_of(spark, folder)
    pipe = pipeline.FeaturePipeline(Config(include_weather=True)).fit(p.where(f"date < date'{FITTED_BEFORE}'"))
    return as_families(pipe.transform(p).drop("feature_engineering_date"))
