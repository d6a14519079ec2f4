"""Counts behind the checks, the quality report as one table, searches over settings, and the life of a stored model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import FILLED, K, PANEL, SQL, as_panel, filled_of, panel_of, query
from catalog.forecasting import BASE, FOLDS, MODELS, predictions_of
from catalog.learning import LAST_WEEKS, parts
from catalog.storage import fresh_folder
from shelfcast import panel as panels
from shelfcast.operators import backtest, baselines, explain, models, profile, runlog, scoring, tuning, validate

IDS = ("store_id", "item_id", "date")

# --- counts behind the checks -----------------------------------------------------------------


@query(
    "date_violations",
    f"""WITH {PANEL}, t AS (SELECT CAST(date AS VARCHAR) AS day, substr(CAST(date AS VARCHAR), 1, 4) || '-02-' || substr(CAST(date AS VARCHAR), 9, 2) AS in_february FROM panel) --result
    SELECT {', '.join(f"count(*) FILTER (WHERE {c} IS NOT NULL AND try_cast({c} AS DATE) IS NULL) AS {c}" for c in ("day", "in_february"))} FROM t""",
)
def _(spark, folder):
    # Every day moved to February: the 30th, the 31st and most of the 29th are no dates.
    day = F.col("date").cast("string")
    moved = panel_of(spark, folder).select(day.alias("day"), F.concat(F.substring(day, 1, 4), F.lit("-02-"), F.substring(day, 9, 2)).alias("in_february"))
    return validate.date_violations(moved, ["day", "in_february"])


@query(
    "raw_violations",
    f"""WITH {PANEL} --result
    SELECT count(*) FILTER (WHERE temperature > 20) AS n_text, count(*) FILTER (WHERE temperature < 0) AS n_negative,
      count(*) FILTER (WHERE precipitation NOT IN (0, 1)) AS n_promo FROM panel""",
)
def _(spark, folder):
    bad = F.when(F.col("temperature") > 20, "warm").otherwise(F.col("temperature").cast("string"))
    return validate.raw_violations(panel_of(spark, folder).select(bad.alias("sales"), F.col("precipitation").cast("int").alias("on_promo")))


@query(
    "feature_violations",
    f"""WITH {PANEL}, t AS (SELECT nullif(store_id, 'ASIA') AS store_id, item_id, date, sales, CASE WHEN on_promo = 1 THEN CAST('inf' AS DOUBLE) ELSE price END AS ratio FROM panel) --result
    SELECT 'null' AS "check", 'store_id' AS "column", count(*) - count(store_id) AS n FROM t
    UNION ALL SELECT 'null', 'item_id', count(*) - count(item_id) FROM t UNION ALL SELECT 'null', 'date', count(*) - count(date) FROM t
    UNION ALL SELECT 'infinite', 'sales', count(*) FILTER (WHERE isinf(sales)) FROM t UNION ALL SELECT 'infinite', 'ratio', count(*) FILTER (WHERE isinf(ratio)) FROM t""",
)
def _(spark, folder):
    p = panel_of(spark, folder)
    ratio = F.when(F.col("on_promo") == 1, F.lit(float("inf"))).otherwise(F.col("price"))
    return validate.feature_violations(p.select(F.nullif("store_id", F.lit("ASIA")).alias("store_id"), "item_id", "date", "sales", ratio.alias("ratio")))


@query(
    "chronology",
    f"""WITH {PANEL}, ends AS (SELECT max(date) AS last FROM panel) --result
    SELECT 'apart' AS split, max(date) FILTER (WHERE date < last - 27) AS train_end, min(date) FILTER (WHERE date >= last - 27) AS val_start, FALSE AS leaks FROM panel, ends
    UNION ALL SELECT 'overlapping', max(date) FILTER (WHERE date < last - 6), min(date) FILTER (WHERE date >= last - 27), TRUE FROM panel, ends""",
    dates=["train_end", "val_start"],
)
def _(spark, folder):
    p = panel_of(spark, folder)
    last = p.agg(F.max("date")).scalar()
    before = lambda n: p.where(F.col("date") < F.date_sub(last, n))
    val = p.where(F.col("date") >= F.date_sub(last, 27))
    both = {"apart": before(27), "overlapping": before(6)}
    return panels.union_all([validate.chronology(train, val).select(F.lit(name).alias("split"), "*") for name, train in both.items()])


# --- the quality report ------------------------------------------------------------------------


def _filled(name: str) -> str:
    """The SQL of a registered query on the panel, on the filled panel."""
    return SQL[name].replace("FROM panel", "FROM filled").replace(PANEL, FILLED) if FILLED not in SQL[name] else SQL[name]


def _section(name: str, source: str, item: str, metrics: list[str]) -> str:
    values = ", ".join(f'CAST("{m}" AS DOUBLE)' for m in metrics)
    return f"SELECT '{name}' AS section, {item} AS item, unnest({metrics}) AS metric, unnest([{values}]) AS value FROM ({source})"


_SERIES = "store_id || '/' || item_id"
_COLUMNS = ["date", "store_id", "item_id", "sales", "on_promo", "price", "temperature", "precipitation"]
_DISTINCT = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM filled" for c in _COLUMNS)
_COPIES = f"""SELECT count(*) AS n_rows, 0 AS exact_copies, 0 AS exact_copies_pct, 0 AS copies_by_key,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT {K} FROM filled)) AS copies_by_series FROM filled"""
REPORT = " UNION ALL ".join([
    _section("cardinality", f"WITH {FILLED} {_DISTINCT}", '"column"', ["n_distinct"]),
    _section("missingness", _filled("missingness"), '"column"', ["n_null", "pct_null"]),
    _section("missing_runs", _filled("missing_runs"), _SERIES, ["n_runs", "n_missing", "max_run", "avg_run"]),
    _section("duplicates", f"WITH {FILLED} {_COPIES}", "''", ["n_rows", "exact_copies", "exact_copies_pct", "copies_by_key", "copies_by_series"]),
    _section("outliers", _filled("outlier_stats"), '"column"',
             ["iqr_count", "z_count", "lower", "upper", "mean", "median", "std", "min", "max", "iqr_pct", "z_pct"]),
    _section("completeness", _filled("completeness"), _SERIES, ["total_days", "missing_days", "completeness"]),
])


@query("quality_report", REPORT, ["value"])
def _(spark, folder):
    return profile.report_table(profile.quality_report(filled_of(spark, folder)))


# --- selections ---------------------------------------------------------------------------------


@query(
    "series_split",
    f"""WITH {PANEL} --result
    SELECT CASE WHEN store_id < 'AS' THEN 'train' WHEN store_id < 'F' THEN 'val' ELSE 'test' END AS part, {K}, date, sales FROM panel""",
    ["sales"],
    ["date"],
)
def _(spark, folder):
    p = panel_of(spark, folder).select(*IDS, "sales")
    keys = panels.series_keys(p)
    groups = [keys.where(rule) for rule in ("store_id < 'AS'", "store_id >= 'AS' and store_id < 'F'", "store_id >= 'F'")]
    found = zip(("train", "val", "test"), panels.split_by_series(as_panel(p), *groups))
    return panels.union_all([part.df.select(F.lit(name).alias("part"), *p.columns) for name, part in found])


@query("model_inputs", f"WITH {PANEL} --result\nSELECT {K}, date, on_promo, price, precipitation FROM panel", ["price", "precipitation"], ["date"])
def _(spark, folder):
    p = panel_of(spark, folder)
    return p.select(*IDS, *panels.feature_columns(p, exclude=["temperature"]))


# --- scoring, importance and settings -----------------------------------------------------------


@dataclass(frozen=True)
class Line:
    """A forecast on one column, with bounds of a fixed width."""

    slope: float
    intercept: float
    column: str = "price"

    def predict(self, df: DataFrame) -> DataFrame:
        yhat = F.col(self.column) * self.slope + self.intercept
        return df.withColumns({"yhat": yhat, "yhat_lower": yhat - 5, "yhat_upper": yhat + 5})

    transform = predict


@query(
    "predict",
    f"""WITH {PANEL}, p AS (SELECT *, price * 0.01 - 14 AS y FROM panel) --result
    SELECT {K}, date, greatest(y, 0) AS yhat, greatest(y - 5, 0) AS yhat_lower, y + 5 AS yhat_upper, 'line' AS model_name, '3' AS model_version FROM p""",
    ["yhat", "yhat_lower", "yhat_upper"],
    ["date"],
)
def _(spark, folder):
    return scoring.predict(Line(0.01, -14.0), panel_of(spark, folder), "line", "3")


@query(
    "permutation_importance",
    f"""WITH {PANEL}, fit AS (SELECT regr_slope(sales, price) AS a, regr_intercept(sales, price) AS b FROM panel),
    r AS (SELECT *, row_number() OVER (ORDER BY md5('42_' || store_id || '_' || item_id || '_' || CAST(date AS VARCHAR)), store_id, item_id, date) - 1 AS r, count(*) OVER () AS n FROM panel),
    e AS (SELECT sqrt(avg(power(x.sales - a * x.price - b, 2))) AS base, sqrt(avg(power(x.sales - a * d.price - b, 2))) AS other
          FROM r x JOIN r d ON d.r = (x.r + 1) % x.n, fit) --result
    SELECT 'price' AS feature, other AS rmse, other - base AS importance FROM e UNION ALL SELECT 'temperature', base, 0.0 FROM e""",
    ["rmse", "importance"],
)
def _(spark, folder):
    p = panel_of(spark, folder)
    fit = p.agg(F.regr_slope("sales", "price").alias("a"), F.regr_intercept("sales", "price").alias("b")).first()
    return explain.permutation_importance(Line(fit.a, fit.b), p.select(*IDS, "sales", "price", "temperature"), ["price", "temperature"])


@dataclass(frozen=True)
class RecentMean:
    """Each series' mean of its last ``window`` rows."""

    window: int

    def fit(self, train: DataFrame) -> RecentMean.Fitted:
        return self.Fitted(baselines.moving_average(as_panel(train), 1, self.window))

    @dataclass(frozen=True)
    class Fitted:
        means: DataFrame

        def predict(self, df: DataFrame) -> DataFrame:
            return df.join(self.means.select("store_id", "item_id", F.col("sales").alias("yhat")), ["store_id", "item_id"], "left")


WINDOWS = [1, 2, 3, 5, 7, 10, 14, 21, 28, 42, 56, 84]


@query(
    "tune_by_halving",
    f"""WITH {PANEL}, trials(trial, w) AS (VALUES {', '.join(f'({i}, {w})' for i, w in enumerate(WINDOWS))}),
    folds AS (SELECT CAST(i AS INTEGER) AS fold, max(date) - CAST((4 - i) * 28 - 1 AS INTEGER) AS val_start FROM panel, range(1, 4) t(i) GROUP BY i),
    past AS (SELECT fold, {K}, sales, row_number() OVER (PARTITION BY fold, {K} ORDER BY date DESC) AS back FROM folds JOIN panel ON date < val_start),
    means AS (SELECT trial, fold, {K}, avg(sales) AS m FROM past JOIN trials ON back <= w GROUP BY trial, fold, {K}),
    scored AS (SELECT trial, m.fold, sqrt(avg((p.sales - m) * (p.sales - m))) AS value FROM means m JOIN folds f ON f.fold = m.fold
      JOIN panel p ON p.store_id = m.store_id AND p.item_id = m.item_id AND p.date >= val_start AND p.date < val_start + 28 GROUP BY trial, m.fold),
    one AS (SELECT trial, value AS score FROM scored WHERE fold = 3 ORDER BY score, trial LIMIT {len(WINDOWS) // 3}),
    two AS (SELECT trial, score + value AS score FROM one JOIN scored USING (trial) WHERE fold = 2 ORDER BY score, trial LIMIT 2) --result
    SELECT trial, CAST(4 - fold AS INTEGER) AS rung, fold, 'RMSE' AS metric, value FROM scored
    WHERE fold = 3 OR (fold = 2 AND trial IN (SELECT trial FROM one)) OR (fold = 1 AND trial IN (SELECT trial FROM two))""",
    ["value"],
)
def _(spark, folder):
    panel = as_panel(panel_of(spark, folder).select(*IDS, "sales"))
    found = tuning.halving(panel, [{"window": w} for w in WINDOWS], lambda p: RecentMean(**p), featurise=False)
    return found[1].select("trial", "rung", "fold", "metric", "value")


# --- stored models ------------------------------------------------------------------------------


@query(
    "model_stages",
    f"""{BASE}, {FOLDS}, {MODELS} --result
    SELECT name, version, CASE WHEN version = 3 THEN 'Production' ELSE stage END AS stage, run_id FROM models WHERE name = 'naive'""",
)
def _(spark, folder):
    per = backtest.fold_metrics(predictions_of(spark, folder))
    table = per.select(F.col("model").alias("name"), F.col("fold").alias("version"),
                       F.when(F.col("fold") % 2 == 0, "Production").otherwise("Staging").alias("stage"), F.lit("").alias("path"),
                       F.concat_ws("-", "model", "fold").alias("run_id"), F.lit("2002-01-01").cast("timestamp").alias("changed_at"))
    later = runlog.promote(table, "naive", 3, "Production", "2002-02-01")
    return runlog.list_models(table.unionByName(later), "naive").drop("path", "changed_at")


@query("champion_life_cycle", LAST_WEEKS + ", date, TRUE AS same FROM filled, ends WHERE date > last - 28", [], ["date"])
def _(spark, folder):
    """Two models stored, the second promoted, loaded by name, and compared with the one that was stored."""
    train, val = parts(spark, folder)
    root = fresh_folder(spark)
    fitted = [models.TrendSeasonalityForecaster(regressors=r).fit(train) for r in ((), ("on_promo",))]
    for version, model in enumerate(fitted, 1):
        model.save(f"{root}/{version}")
    rows = [("trend", version, "Staging", f"{root}/{version}", f"run-{version}") for version in (1, 2)]
    entered = spark.createDataFrame(rows, "name string, version int, stage string, path string, run_id string")
    runlog.log_models(entered.withColumn("changed_at", F.lit("2002-01-01").cast("timestamp")), f"{root}/table")
    table = spark.read.schema(runlog.MODEL_SCHEMA).parquet(f"{root}/table")
    runlog.log_models(runlog.promote(table, "trend", 2, "Production", "2002-02-01"), f"{root}/table")
    table = spark.read.schema(runlog.MODEL_SCHEMA).parquet(f"{root}/table")
    champion = runlog.load_champion(table, spark.createDataFrame([], runlog.RUN_SCHEMA), "trend")
    stored = fitted[1].predict(val).select(*IDS, F.col("yhat").alias("stored"))
    both = champion.predict(val).select(*IDS, "yhat").join(stored, list(IDS), "left")
    return both.select(*IDS, F.coalesce(F.abs(F.col("yhat") - F.col("stored")) <= 1e-9 * (1 + F.abs("stored")), F.lit(False)).alias("same"))
