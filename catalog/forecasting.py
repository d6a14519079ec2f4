"""Baselines, accuracy metrics, backtests and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import FILLED, K, W, as_panel, filled_of, query
from catalog.data_quality import IMPUTED
from shelfcast.functions.normal import norm_cdf
from shelfcast.operators import backtest, baselines, clean, metrics, runlog

BASE = f"WITH {FILLED}, {IMPUTED}"


def imputed_of(spark, folder):
    return clean.impute_sales(filled_of(spark, folder)).select("date", "store_id", "item_id", "sales")


KNOWN = f"""
known AS (SELECT {K}, date, sales, row_number() OVER (PARTITION BY {K} ORDER BY date DESC) AS back,
          row_number() OVER ({W}) AS pos, count(*) OVER (PARTITION BY {K}) AS n, max(date) OVER (PARTITION BY {K}) AS last FROM panel)"""


AHEAD = "(SELECT CAST(j AS INTEGER) AS j FROM range(0, 28) t(j)) days"
NAIVE = f"SELECT {K}, last + j + 1 AS date, sales, 'naive' AS forecast_type FROM known, {AHEAD} WHERE back = 1"
SEASONAL = (f"SELECT {K}, last + j + 1 AS date, sales, 'seasonal_naive' AS forecast_type FROM known, {AHEAD} "
            "WHERE (n >= 7 AND back = 7 - j % 7) OR (n < 7 AND back = 1)")
AVERAGE = (f"SELECT {K}, last + j + 1 AS date, m AS sales, 'moving_average' AS forecast_type FROM "
           f"(SELECT {K}, last, avg(sales) AS m FROM known WHERE back <= 7 GROUP BY {K}, last), {AHEAD}")
SES = (f"SELECT {K}, last + j + 1 AS date, level AS sales, 'exponential_smoothing' AS forecast_type FROM "
       f"(SELECT {K}, last, list_reduce(list(CAST(sales AS DOUBLE) ORDER BY date), lambda a, x: 0.3 * x + 0.7 * a) AS level FROM known GROUP BY {K}, last), {AHEAD}")
FORMS = {"naive": NAIVE, "seasonal_naive": SEASONAL, "moving_average": AVERAGE, "ses": SES}
FUNCTIONS = {"naive": baselines.naive, "seasonal_naive": baselines.seasonal_naive,
             "moving_average": baselines.moving_average, "ses": baselines.exponential_smoothing}

for _name, _form in FORMS.items():

    @query(_name, f"WITH {FILLED}, {KNOWN} --result\n{_form}", ["sales"], ["date"])
    def _(spark, folder, fn=FUNCTIONS[_name]):
        return fn(as_panel(filled_of(spark, folder)), 28)


@query("all_baselines", f"WITH {FILLED}, {KNOWN} --result\n{' UNION ALL '.join(f'({f})' for f in FORMS.values())}", ["sales"], ["date"])
def _(spark, folder):
    return baselines.all_baselines(as_panel(filled_of(spark, folder)), 28)


@query(
    "one_step_naive",
    f"WITH {FILLED} --result\nSELECT date, {K}, sales, coalesce(lag(sales) OVER ({W}), avg(sales) OVER (PARTITION BY {K})) AS yhat FROM filled",
    ["sales", "yhat"],
    ["date"],
)
def _(spark, folder):
    return baselines.one_step_naive(as_panel(filled_of(spark, folder))).select("date", "store_id", "item_id", "sales", "yhat")


# --- metrics on one-step forecasts ----------------------------------------------------------

STEP = f"""
step AS (SELECT date, {K}, sales AS actual, coalesce(lag(sales) OVER ({W}), avg(sales) OVER (PARTITION BY {K})) AS forecast FROM filled),
err AS (SELECT *, actual - forecast AS e, (abs(actual) + abs(forecast)) / 2 AS half FROM step WHERE actual IS NOT NULL AND forecast IS NOT NULL)"""

METRICS = """sqrt(avg(e * e)) AS "RMSE", avg(abs(e)) AS "MAE", avg(abs(e / actual)) FILTER (WHERE actual <> 0) * 100 AS "MAPE",
  avg(abs(e) / half) FILTER (WHERE half <> 0) * 100 AS "sMAPE" """
R2 = """, 1 - sum(e * e) / nullif(var_pop(actual) * count(*), 0) AS "R2" """
NAMES = ["RMSE", "MAE", "MAPE", "sMAPE"]


def step_of(spark, folder):
    p = baselines.one_step_naive(as_panel(filled_of(spark, folder)))
    return p.select("date", "store_id", "item_id", F.col("sales").alias("actual"), F.col("yhat").alias("forecast"))


@query("metrics_overall", f"WITH {FILLED}, {STEP} --result\nSELECT {METRICS}{R2} FROM err", [*NAMES, "R2"])
def _(spark, folder):
    return metrics.point_metrics(step_of(spark, folder))


@query("metrics_series", f"WITH {FILLED}, {STEP} --result\nSELECT {K}, {METRICS}, count(*) AS length FROM err GROUP BY {K}", NAMES)
def _(spark, folder):
    return metrics.series_metrics(step_of(spark, folder))


def aggregated_sql(how: str) -> str:
    one = {"mean": "avg({m})", "median": "quantile_cont({m}, 0.5)", "weighted": "sum({m} * length) / sum(length)"}[how]
    cols = ", ".join(one.format(m=f'"{m}"') + f' AS "{m}"' for m in NAMES)
    return f"WITH {FILLED}, {STEP}, per AS (SELECT {K}, {METRICS}, count(*) AS length FROM err GROUP BY {K}) --result\nSELECT {cols} FROM per"


for _how in ("mean", "median", "weighted"):

    @query(f"metrics_{_how}", aggregated_sql(_how), NAMES)
    def _(spark, folder, how=_how):
        return metrics.aggregate_metrics(metrics.series_metrics(step_of(spark, folder)), NAMES, how)


BANDS = f"""
bands AS (SELECT actual, avg(actual) OVER w - 1.28 * coalesce(stddev_samp(actual) OVER w, 0) AS q10, avg(actual) OVER w AS q50,
                 avg(actual) OVER w + 1.28 * coalesce(stddev_samp(actual) OVER w, 0) AS q90, {K}
          FROM step WINDOW w AS (PARTITION BY {K} ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, actual - q50 AS e, (abs(actual) + abs(q50)) / 2 AS half FROM bands WHERE actual IS NOT NULL AND q50 IS NOT NULL)"""
QUANTILE = ["RMSE", "MAE", "MAPE", "sMAPE", "R2", "Pinball_0.1", "Pinball_0.5", "Pinball_0.9", "Coverage_80", "Coverage_90", "Interval_Width"]


@query(
    "quantile_metrics",
    f"""WITH {FILLED}, {STEP}, {BANDS} --result
    SELECT {K}, {METRICS}{R2}, avg(greatest(0.1 * (actual - q10), -0.9 * (actual - q10))) AS "Pinball_0.1",
      avg(greatest(0.5 * (actual - q50), -0.5 * (actual - q50))) AS "Pinball_0.5", avg(greatest(0.9 * (actual - q90), -0.1 * (actual - q90))) AS "Pinball_0.9",
      avg(CASE WHEN actual BETWEEN q10 AND q90 THEN 1 ELSE 0 END) * 100 AS "Coverage_80",
      avg(CASE WHEN actual BETWEEN q10 AND q90 THEN 1 ELSE 0 END) * 100 AS "Coverage_90", avg(q90 - q10) AS "Interval_Width"
    FROM b GROUP BY {K}""",
    QUANTILE,
)
def _(spark, folder):
    from shelfcast.functions.series import preceding, series_window

    f = preceding(series_window(), 28)
    s = step_of(spark, folder)
    mean, spread = F.avg("actual").over(f), 1.28 * F.coalesce(F.stddev_samp("actual").over(f), F.lit(0.0))
    s = s.withColumns({"q10": mean - spread, "q50": mean, "q90": mean + spread}).where("actual is not null and q50 is not null")
    return metrics.quantile_metrics(s, by=["store_id", "item_id"])


@query(
    "mase",
    f"""WITH {FILLED}, {STEP},
    d AS (SELECT {K}, abs(sales - lag(sales, 7) OVER ({W})) AS d FROM filled WHERE date < DATE '2000-01-01'),
    s AS (SELECT {K}, avg(d) AS scale FROM d GROUP BY {K}),
    m AS (SELECT {K}, avg(abs(e)) AS mae FROM err WHERE date >= DATE '2000-01-01' GROUP BY {K}) --result
    SELECT {K}, mae / nullif(scale, 0) AS "MASE" FROM m LEFT JOIN s USING ({K})""",
    ["MASE"],
)
def _(spark, folder):
    cut = F.to_date(F.lit("2000-01-01"))
    train = filled_of(spark, folder).where(F.col("date") < cut)
    return metrics.mase(step_of(spark, folder).where(F.col("date") >= cut), train, season=7)


@query("residuals", f"WITH {FILLED}, {STEP} --result\nSELECT date, {K}, actual, forecast, actual - forecast AS residual FROM step",
       ["actual", "forecast", "residual"], ["date"])
def _(spark, folder):
    return metrics.residuals(step_of(spark, folder))


@query(
    "residual_histogram",
    f"""WITH {FILLED}, {STEP}, b AS (SELECT min(e) AS lo, max(e) AS hi, (max(e) - min(e)) / 30 AS step FROM err),
    c AS (SELECT CAST(least(floor((e - lo) / ((hi - lo) / 30)) + 1, 30) AS INTEGER) AS bin FROM err, b) --result
    SELECT bin, lo + (bin - 1) * step AS lower, lo + bin * step AS upper, (SELECT count(*) FROM c WHERE c.bin = bins.bin) AS n
    FROM (SELECT CAST(i AS INTEGER) AS bin FROM range(1, 31) r(i)) bins, b""",
    ["lower", "upper"],
)
def _(spark, folder):
    return metrics.residual_histogram(step_of(spark, folder))


@query(
    "qq_points",
    f"""WITH {FILLED}, {STEP}, r AS (SELECT {K}, e, row_number() OVER (PARTITION BY {K} ORDER BY e) - 1 AS rank, count(*) OVER (PARTITION BY {K}) AS n FROM err) --result
    SELECT {K}, rank, CASE WHEN rank = 0 THEN 1 - pow(0.5, 1.0 / n) WHEN rank = n - 1 THEN pow(0.5, 1.0 / n) ELSE (rank + 1 - 0.3175) / (n + 0.365) END AS place,
      e AS ordered FROM r""",
    ["place", "ordered"],
)
def _(spark, folder):
    # Shown as probabilities: the distribution function of the theoretical quantiles.
    points = metrics.qq_points(metrics.residuals(step_of(spark, folder)), by=["store_id", "item_id"])
    return points.select("store_id", "item_id", "rank", norm_cdf(F.col("theoretical")).alias("place"), "ordered")


# --- backtest -------------------------------------------------------------------------------

FOLDS = f"""
span AS (SELECT min(date) AS a, date_diff('day', min(date), max(date)) // 6 AS size FROM imputed),
folds AS (SELECT CAST(f AS INTEGER) AS fold, a + CAST(f * size AS INTEGER) AS cut FROM span, range(1, 7) t(f)),
known AS (SELECT f.fold, cut, {K}, date, sales, row_number() OVER (PARTITION BY f.fold, {K} ORDER BY date DESC) AS back,
          count(*) OVER (PARTITION BY f.fold, {K}) AS n, max(date) OVER (PARTITION BY f.fold, {K}) AS last
          FROM imputed JOIN folds f ON date < cut WHERE sales IS NOT NULL),
ahead AS (
  SELECT fold, {K}, last + j + 1 AS date, sales AS forecast, 'naive' AS model FROM known, {AHEAD} WHERE back = 1
  UNION ALL SELECT fold, {K}, last + j + 1, sales, 'seasonal_naive' FROM known, {AHEAD} WHERE (n >= 7 AND back = 7 - j % 7) OR (n < 7 AND back = 1)
  UNION ALL SELECT fold, {K}, last + j + 1, m, 'moving_average' FROM (SELECT fold, {K}, last, avg(sales) AS m FROM known WHERE back <= 7 GROUP BY fold, {K}, last), {AHEAD}
  UNION ALL SELECT fold, {K}, last + j + 1, level, 'exponential_smoothing' FROM
    (SELECT fold, {K}, last, list_reduce(list(CAST(sales AS DOUBLE) ORDER BY date), lambda a, x: 0.3 * x + 0.7 * a) AS level FROM known GROUP BY fold, {K}, last), {AHEAD}),
pred AS (SELECT a.*, i.sales AS actual FROM ahead a JOIN folds f USING (fold)
         JOIN imputed i ON i.store_id = a.store_id AND i.item_id = a.item_id AND i.date = a.date WHERE a.date >= cut AND a.date < cut + 28),
perr AS (SELECT *, actual - forecast AS e, (abs(actual) + abs(forecast)) / 2 AS half FROM pred),
per_fold AS (SELECT model, fold, {METRICS}{R2}, count(*) AS n_val, count(*) FILTER (WHERE forecast IS NULL) AS n_unpredicted
             FROM perr GROUP BY model, fold)"""
ALL = [*NAMES, "R2"]
AGG = ", ".join(f'avg("{m}") AS "{m}", stddev_pop("{m}") AS "{m}_std"' for m in ALL)
AGG_NAMES = [n for m in ALL for n in (m, f"{m}_std")]


def predictions_of(spark, folder):
    return backtest.baseline_backtest(as_panel(imputed_of(spark, folder)))


@query("backtest_baselines", f"{BASE}, {FOLDS} --result\nSELECT fold, {K}, date, model, actual, forecast FROM pred", ["actual", "forecast"], ["date"])
def _(spark, folder):
    return predictions_of(spark, folder)


@query("rolling_backtest", f"{BASE}, {FOLDS} --result\nSELECT fold, {K}, date, 'last' AS model, actual, forecast FROM pred WHERE model = 'naive'",
       ["actual", "forecast"], ["date"])
def _(spark, folder):
    """The last known value through the fit and predict hooks."""
    panel = as_panel(imputed_of(spark, folder))

    def fit(train):
        known = train.where("sales is not null")
        return known.groupBy("store_id", "item_id").agg(F.max_by("sales", "date").alias("yhat"))

    found, _ = backtest.rolling_backtest(panel, fit, lambda last, rows: rows.drop("yhat").join(last, ["store_id", "item_id"], "left"), n_folds=6, name="last")
    return found.select("fold", "store_id", "item_id", "date", "model", "actual", "forecast")


@query("fold_metrics", f"{BASE}, {FOLDS} --result\nSELECT * FROM per_fold", ALL)
def _(spark, folder):
    return backtest.fold_metrics(predictions_of(spark, folder))


@query("aggregate_folds", f"{BASE}, {FOLDS} --result\nSELECT model, {AGG} FROM per_fold GROUP BY model", AGG_NAMES)
def _(spark, folder):
    return backtest.aggregate_folds(backtest.fold_metrics(predictions_of(spark, folder)))


@query(
    "champion",
    f"""{BASE}, {FOLDS}, agg AS (SELECT model, {AGG} FROM per_fold GROUP BY model) --result
    SELECT *, coalesce("sMAPE" + 0.1 * coalesce("sMAPE_std", 0), 'Infinity'::DOUBLE) AS score FROM agg ORDER BY score, model LIMIT 1""",
    [*AGG_NAMES, "score"],
)
def _(spark, folder):
    return backtest.select_champion(backtest.aggregate_folds(backtest.fold_metrics(predictions_of(spark, folder))))


@query(
    "leaderboard",
    f'{BASE}, {FOLDS} --result\nSELECT model, {", ".join(f"""avg("{m}") AS "{m}" """ for m in ALL)} FROM per_fold GROUP BY model',
    ALL,
)
def _(spark, folder):
    long = backtest.metrics_long(backtest.fold_metrics(predictions_of(spark, folder)))
    return metrics.compare_models(long)


def runs_of(spark, folder):
    long = backtest.metrics_long(backtest.fold_metrics(predictions_of(spark, folder)))
    return long.select(F.concat_ws("-", "model", "fold").alias("run_id"), "model", "fold", "metric", "value",
                       F.lit("2002-01-01").cast("timestamp").alias("logged_at"))


@query(
    "best_runs",
    f"""{BASE}, {FOLDS} --result
    SELECT model || '-' || fold AS run_id, model, fold, 'sMAPE' AS metric, "sMAPE" AS value FROM per_fold WHERE "sMAPE" IS NOT NULL ORDER BY "sMAPE", run_id LIMIT 10""",
    ["value"],
)
def _(spark, folder):
    return runlog.best_runs(runs_of(spark, folder), limit=10).drop("logged_at")


MODELS = f"""
models AS (SELECT model AS name, fold AS version, CASE WHEN fold % 2 = 0 THEN 'Production' ELSE 'Staging' END AS stage, model || '-' || fold AS run_id FROM per_fold)"""


@query(
    "latest_model",
    f"""{BASE}, {FOLDS}, {MODELS} --result
    SELECT name, version, stage, run_id FROM (SELECT *, row_number() OVER (PARTITION BY name, stage ORDER BY version DESC) AS n FROM models) WHERE n = 1""",
)
def _(spark, folder):
    per = backtest.fold_metrics(predictions_of(spark, folder))
    models = per.select(F.col("model").alias("name"), F.col("fold").alias("version"),
                        F.when(F.col("fold") % 2 == 0, "Production").otherwise("Staging").alias("stage"), F.lit("").alias("path"),
                        F.concat_ws("-", "model", "fold").alias("run_id"), F.lit("2002-01-01").cast("timestamp").alias("changed_at"))
    return runlog.latest_model(models).drop("path", "changed_at")
