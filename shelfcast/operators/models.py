"""Trained forecasters on pyspark.ml.

Every forecaster has ``fit(train) -> fitted`` and ``fitted.predict(future) -> DataFrame`` with
``yhat`` (and ``yhat_lower``, ``yhat_upper`` where the model has an interval). The boosted ones
take feature tables, the classical ones the panel itself. What a fitted model keeps per series is
written once to the checkpoint folder, so predicting does not read the training rows again.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields, is_dataclass
from statistics import NormalDist

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.config import DATE, KEYS, TARGET
from shelfcast.functions.normal import norm_ppf
from shelfcast.functions.ranking import checkpointed
from shelfcast.functions.series import add_ema, change_base, pct_change, series_window
from shelfcast.operators import trees
from shelfcast.operators.explain import linear_contributions, tree_importance
from shelfcast.operators.features.calendar import calendar_columns, fourier
from shelfcast.operators.features.holiday import add_holidays
from shelfcast.operators.features.lag import SAFE_ALPHA, safe_columns
from shelfcast.operators.quantiles import exact_quantiles
from shelfcast.panel import union_all

#: Rows of the overall mean that the mean of a key is drawn by.
PRIOR_ROWS = 10.0


# --- inputs ---------------------------------------------------------------------------------


def model_features(df: DataFrame, target: str = TARGET, keys: Sequence[str] = KEYS, date: str = DATE,
                   holidays: DataFrame | None = None) -> DataFrame:
    """Columns a model may see: calendar, holidays, earlier values of the target, promotion and price."""
    w = series_window(keys, date)
    out = add_ema(df, target, f"{target}_ema_14", SAFE_ALPHA, adjust=True, keys=keys, date=date, shift=1)
    one = safe_columns(df.columns, target, w)
    if "price" in df.columns:
        one.update(change_base(F.col("price"), w, "_price"))
    out = out.withColumns(one)
    if "price" in df.columns:
        out = out.withColumn("price_pct_change", pct_change("_price")).drop("_price_now", "_price_before")
    return add_holidays(out.withColumns(calendar_columns(date)), holidays, date)


def future_features(history: DataFrame, future: DataFrame, target: str = TARGET, keys: Sequence[str] = KEYS, date: str = DATE,
                    holidays: DataFrame | None = None) -> DataFrame:
    """Features of rows after the history, whose target is not known: lags longer than the step are real."""
    cut = future.agg(F.min(date)).first()[0]
    blind = future.withColumn(target, F.lit(None).cast("double")) if target in future.columns else future
    past = history.where(F.col(date) < F.lit(cut))
    both = past.unionByName(blind, allowMissingColumns=True)
    return model_features(both, target, keys, date, holidays).where(F.col(date) >= F.lit(cut))


def input_columns(df: DataFrame, target: str = TARGET, keys: Sequence[str] = KEYS, date: str = DATE) -> list[str]:
    """Model inputs of a feature table: numbers and flags, without target, date, keys and same-day measures."""
    skip = {target, date, *keys, "is_outlier", "is_missing", "temperature", "precipitation"}
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def to_model_matrix(df: DataFrame, features: Sequence[str], target: str = TARGET) -> DataFrame:
    """``features`` vector and ``label``; missing values become 0 and infinities the largest numbers."""
    return matrix_pipeline(features).fit(df).transform(df).withColumn("label", F.col(target).cast("double"))


def _clean_sql(features: Sequence[str]) -> str:
    big = "1.7976931348623157E308D"
    parts = [f"least(greatest(coalesce(nanvl(cast(`{c}` as double), 0D), 0D), -{big}), {big}) AS `_x_{c}`" for c in features]
    return f"SELECT *, {', '.join(parts)} FROM __THIS__"


def matrix_pipeline(features: Sequence[str]) -> Pipeline:
    vector = VectorAssembler(inputCols=[f"_x_{c}" for c in features], outputCol="features")
    return Pipeline(stages=[SQLTransformer(statement=_clean_sql(features)), vector])


# --- boosted trees --------------------------------------------------------------------------


@dataclass(frozen=True)
class GbtForecaster:
    """Gradient-boosted trees over a feature table.

    Each key, and all keys together, enter as the mean of the target that their rows had on earlier days, drawn
    towards the mean of all rows: a number that says something, however many values a key has.
    """

    max_depth: int = 5
    max_iter: int = 100
    step_size: float = 0.05
    subsampling_rate: float = 0.8
    feature_share: float = 0.9
    min_instances: int = 1
    seed: int = 42
    target: str = TARGET
    keys: tuple[str, ...] = KEYS
    inputs: tuple[str, ...] = ()
    date: str = DATE

    def fit(self, train: DataFrame, beside: Callable[[], object] | None = None) -> FittedGbt | tuple[FittedGbt, object]:
        """The fitted model; with ``beside``, which runs meanwhile, also what that returns."""
        if beside:
            # The short jobs of one leave room for those of the other.
            with ThreadPoolExecutor(1) as pool:
                other = pool.submit(inheritable_thread_target(train.sparkSession)(beside))
                return self.fit(train), other.result()
        inputs = list(self.inputs) or input_columns(train, self.target, self.keys)
        train = train.where(F.col(self.target).isNotNull())
        order = [c for c in (*self.keys, self.date) if c in train.columns]
        train = train.select(*order, *[c for c in inputs if c not in order], F.col(self.target).cast("double").alias(self.target))
        levels = key_levels(self.keys)
        # Read by every mean, so that the features are not built again for them.
        slim = checkpointed(train.select(*order, self.target))
        for name, by in levels.items():
            train = train.join(earlier_means(slim, by, f"_mean_{name}", self.target, self.date), [*by, self.date], "left")
        # Spread over series and days, in one order whatever the files were, so the same data gives the same trees.
        train = train.repartition(*order).sortWithinPartitions(*order)
        means = checkpointed(key_means(slim, levels, self.target))
        vector = VectorAssembler(inputCols=[f"_x_{c}" for c in inputs] + [f"_mean_{name}" for name in levels], outputCol="features")
        matrix = PipelineModel([SQLTransformer(statement=_clean_sql(inputs)), vector])
        # Written with its rows where they are: a round is a short job for each level of its tree, and each of their tasks
        # is sent all that stands behind the rows.
        ready = checkpointed(matrix.transform(train.fillna(0.0, [f"_mean_{name}" for name in levels])).select("features", self.target))
        trees_of = GBTRegressor(
            featuresCol="features", labelCol=self.target, maxDepth=self.max_depth, maxIter=self.max_iter, stepSize=self.step_size,
            subsamplingRate=self.subsampling_rate, featureSubsetStrategy=str(self.feature_share),
            minInstancesPerNode=self.min_instances, seed=self.seed,
        )
        return FittedGbt(PipelineModel([*matrix.stages, trees_of.fit(ready)]), tuple(inputs + list(levels)), means, self.keys)


def key_levels(keys: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Columns of each mean that stands for keys: every key, and ``series`` for all of them together."""
    return {**{k: (k,) for k in keys}, **({"series": tuple(keys)} if len(keys) > 1 else {})}


def earlier_means(df: DataFrame, by: Sequence[str], out: str, target: str = TARGET, date: str = DATE, weight: float = PRIOR_ROWS) -> DataFrame:
    """(``by``, date, ``out``): the mean target of a key's rows on earlier days, with ``weight`` rows of the mean of all
    rows on earlier days; null on the first day. Windows run over days, not rows, so no key is too large for them."""
    value = F.col(target).cast("double")

    def before(keys: Sequence[str], s: str, n: str) -> DataFrame:
        daily = df.groupBy(*keys, date).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_s"), F.count(value).alias("_n"))
        past = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
        return daily.select(*keys, date, F.coalesce(F.sum("_s").over(past), F.lit(0.0)).alias(s), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias(n))

    joined = before(by, "_s", "_n").join(before([], "_all", "_rows"), date)
    usual = F.when(F.col("_rows") > 0, F.col("_all") / F.col("_rows"))
    return joined.select(*by, date, ((F.col("_s") + weight * usual) / (F.col("_n") + weight)).alias(out))


def key_means(df: DataFrame, levels: dict[str, tuple[str, ...]], target: str = TARGET, weight: float = PRIOR_ROWS) -> DataFrame:
    """(column, value, mean) for later rows: the means of all rows of a key. The row without a value has the mean of
    all rows, which stands for keys that are not there."""
    value = F.col(target).cast("double")
    usual = df.agg(F.avg(value)).first()[0] or 0.0
    mean = (F.sum(value) + weight * usual) / (F.count(value) + weight)
    parts = [df.where(value.isNotNull()).groupBy(*by).agg(mean.alias("mean")).select(F.lit(name).alias("column"), _key_text(by).alias("value"), "mean") for name, by in levels.items()]
    whole = df.sparkSession.createDataFrame([(name, None, float(usual)) for name in levels], "column string, value string, mean double")
    return union_all([*parts, whole])


def _key_text(by: Sequence[str]) -> Column:
    """One text for the values of several columns; none for two different rows of values."""
    return F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(by)]))


def _with_means(df: DataFrame, means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_mean_`` columns of the keys, from what ``key_means`` stored."""
    usual = {r.column: r["mean"] for r in means.where("value is null").collect()}
    for name, by in key_levels(keys).items():
        part = means.where((F.col("column") == name) & F.col("value").isNotNull()).select(F.col("value").alias("_v"), F.col("mean").alias("_m"))
        df = df.join(part, _key_text(by) == F.col("_v"), "left")
        df = df.withColumn(f"_mean_{name}", F.coalesce("_m", F.lit(usual.get(name, 0.0)))).drop("_v", "_m")
    return df


@dataclass(frozen=True)
class FittedGbt:
    pipeline: PipelineModel
    inputs: tuple[str, ...]
    means: DataFrame
    keys: tuple[str, ...] = KEYS

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.pipeline.transform(_with_means(df, self.means, self.keys))
        return out.select(*df.columns, F.col("prediction").alias("yhat"))

    predict = transform

    def with_leaves(self, df: DataFrame) -> DataFrame:
        """``df`` with ``yhat`` and, in ``_leaves``, the leaf that a row reaches in each tree."""
        out = trees.with_leaves(self.pipeline, _with_means(df, self.means, self.keys))
        return out.select(*df.columns, F.col("prediction").alias("yhat"), trees.LEAVES)

    def contributions(self, df: DataFrame, date: str = DATE) -> DataFrame:
        """(keys, date, feature, contribution): what each input adds to the forecast of a row, exactly."""
        return trees.tree_contributions(self.pipeline, _with_means(df, self.means, self.keys), self.inputs, (*self.keys, date))

    def bias(self) -> float:
        """The forecast before any input is looked at."""
        return trees.path_table(trees.node_table(self.pipeline.stages[-1])).bias

    def feature_importance(self) -> DataFrame:
        return tree_importance(self.pipeline.stages[-1], list(self.inputs))

    def save(self, path: str) -> None:
        _save(path, "gbt", Stored(self.inputs, self.keys), {}, {"means": self.means})
        self.pipeline.write().overwrite().save(f"{path}/pipeline")

    @staticmethod
    def load(path: str) -> FittedGbt:
        spec, _, tables = _load(path, Stored, ["means"])
        return FittedGbt(PipelineModel.load(f"{path}/pipeline"), spec.inputs, tables["means"], spec.keys)


@dataclass(frozen=True)
class Stored:
    """Settings of a fitted boosted model."""

    inputs: tuple[str, ...]
    keys: tuple[str, ...]


def gbt_forecaster(**kw) -> GbtForecaster:
    return GbtForecaster(**{"max_depth": 5, "feature_share": 0.9, **kw})


def boosted_depth_forecaster(**kw) -> GbtForecaster:
    return GbtForecaster(**{"max_depth": 6, "feature_share": 0.8, **kw})


@dataclass(frozen=True)
class QuantileForecaster:
    """A point model with quantiles of its residuals, given the leaves that a row reaches.

    A model of the earlier rows is held against the last ``horizon`` days. How its residuals are spread is counted for
    each leaf; a row's quantiles are those of its leaves together, so they widen where the trees found the rows hard to
    tell. Quantiles are added to the point in order, so intervals cannot cross.
    """

    base: GbtForecaster = field(default_factory=GbtForecaster)
    quantiles: tuple[float, float, float] = (0.1, 0.5, 0.9)
    horizon: int = 28
    date: str = DATE

    def fit(self, train: DataFrame) -> FittedQuantile:
        b = self.base
        inputs = list(b.inputs) or input_columns(train, b.target, b.keys, self.date)
        # Read by two fits and the calibration.
        train = train.select(*b.keys, self.date, b.target, *inputs).persist()
        try:
            return self._fit(b, train)
        finally:
            train.unpersist()

    def _fit(self, b: GbtForecaster, train: DataFrame) -> FittedQuantile:
        last = train.agg(F.max(self.date)).first()[0]
        cut = F.date_sub(F.lit(last), self.horizon - 1)
        head, tail = train.where(F.col(self.date) < cut), train.where(F.col(self.date) >= cut)

        def calibrated() -> tuple[FittedGbt, list[float], DataFrame]:
            probe = b.fit(head)
            scored = checkpointed(probe.with_leaves(tail).select(trees.LEAVES, (F.col(b.target) - F.col("yhat")).alias("r")).where("r is not null"))
            edges = exact_quantiles(scored, ["r"], [i / trees.CELLS for i in range(trees.CELLS + 1)])["r"] or [0.0] * (trees.CELLS + 1)
            return probe, edges, checkpointed(trees.leaf_cells(scored, "r", edges))

        point, (probe, edges, cells) = b.fit(train, calibrated)  # neither fit needs the other
        return FittedQuantile(point, probe, cells, tuple(edges), self.quantiles, b.keys)


@dataclass(frozen=True)
class FittedQuantile:
    point: FittedGbt
    probe: FittedGbt
    cells: DataFrame
    edges: tuple[float, ...]
    quantiles: tuple[float, ...]
    keys: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        told = self.probe.with_leaves(self.point.transform(df).withColumnRenamed("yhat", "_point")).drop("yhat")
        shift = trees.leaf_quantiles(self.cells, self.edges, self.quantiles)
        out = told.withColumn("_shift", shift)
        out = out.withColumns({n: F.col("_point") + F.col("_shift")[i] for i, n in enumerate(("q10", "q50", "q90"))})
        return out.withColumns({"yhat": F.col("q50"), "yhat_lower": F.col("q10"), "yhat_upper": F.col("q90")}).drop("_shift", "_point", trees.LEAVES)

    predict = transform

    def contributions(self, df: DataFrame, date: str = DATE) -> DataFrame:
        """Of the point model."""
        return self.point.contributions(df, date)

    def save(self, path: str) -> None:
        _save(path, "quantile", Stored(self.point.inputs, self.keys), {"edges": self.edges, "quantiles": self.quantiles}, {"cells": self.cells})
        self.point.save(f"{path}/point")
        self.probe.save(f"{path}/probe")

    @staticmethod
    def load(path: str) -> FittedQuantile:
        spec, state, tables = _load(path, Stored, ["cells"])
        return FittedQuantile(FittedGbt.load(f"{path}/point"), FittedGbt.load(f"{path}/probe"), tables["cells"], tuple(state["edges"]), tuple(state["quantiles"]), spec.keys)


# --- seasonal autoregression ----------------------------------------------------------------


def difference_weights(d: int, seasonal_d: int, season: int) -> list[float]:
    """c with y[t] = diff[t] + sum c[k-1] * y[t-k], for d plain and seasonal_d seasonal differences."""
    poly = [1.0]
    for lag in [1] * d + [season] * seasonal_d:
        nxt = poly + [0.0] * lag
        for i, v in enumerate(poly):
            nxt[i + lag] -= v
        poly = nxt
    return [-v for v in poly[1:]]


def _number(v: float) -> str:
    return f"double('{v!r}')"


def _name(c: str) -> str:
    return f"`{c.replace('`', '``')}`"


@dataclass(frozen=True)
class SeasonalArForecaster:
    """One autoregression with moving-average terms on differenced, series-scaled data, shared by all series.

    Orders are (p, d, q) and (P, D, Q, s). With q or Q, a long autoregression comes first; what it leaves over stands
    for the shocks, whose earlier values are inputs of the second fit beside those of the series. Both fits are sums
    of products over all rows.
    """

    order: tuple[int, int, int] = (1, 1, 1)
    seasonal: tuple[int, int, int, int] = (1, 1, 1, 12)
    exog: tuple[str, ...] = ()
    alpha: float = 0.05
    target: str = TARGET
    keys: tuple[str, ...] = KEYS
    date: str = DATE

    @property
    def lags(self) -> list[int]:
        return sorted({*range(1, self.order[0] + 1), *(self.seasonal[3] * j for j in range(1, self.seasonal[0] + 1))})

    @property
    def shocks(self) -> list[int]:
        return sorted({*range(1, self.order[2] + 1), *(self.seasonal[3] * j for j in range(1, self.seasonal[2] + 1))})

    @property
    def long_lags(self) -> list[int]:
        """Of the first fit: enough to write the moving average as an autoregression, nearly."""
        near = 4 * max(self.order[0] + self.order[2], 1)
        return sorted({*range(1, near + 1), *(self.seasonal[3] * j for j in range(1, self.seasonal[0] + 2 * self.seasonal[2] + 1))})

    def _least_squares(self, rows: DataFrame, names: list[str], spread: bool = True) -> tuple[list[float], float, float | None]:
        """Coefficients, intercept and spread of ``_z`` given ``names``, over the rows that have all of them. The spread
        takes another pass over them, so it is left out where ``spread`` says so."""
        data = rows.select(*[F.col(c).cast("double").alias(c) for c in ["_z", *names]]).dropna()
        if not names:
            mean, sigma = data.agg(F.avg("_z"), F.stddev_samp("_z")).first()
            return [], float(mean or 0.0), float(sigma or 0.0)
        data = VectorAssembler(inputCols=names, outputCol="_v").transform(data)
        lr = LinearRegression(featuresCol="_v", labelCol="_z", predictionCol="_p", regParam=1e-6).fit(data)
        return [float(v) for v in lr.coefficients], float(lr.intercept), float(lr.summary.rootMeanSquaredError) if spread else None

    def _lagged(self, rows: DataFrame, column: str, lags: Sequence[int]) -> DataFrame:
        over = f"OVER (PARTITION BY {', '.join(map(_name, self.keys))} ORDER BY {_name(self.date)})"
        return rows.selectExpr("*", *(f"lag({column}, {k}) {over} AS {column}{k}" for k in lags))

    def fit(self, train: DataFrame) -> FittedSeasonalAr:
        w = series_window(self.keys, self.date)
        weights = difference_weights(self.order[1], self.seasonal[1], self.seasonal[3])
        y = F.col(self.target).cast("double")
        diff = y
        for k, c in enumerate(weights, 1):
            if c:
                diff = diff - c * F.lag(y, k).over(w)
        rows = train.where(y.isNotNull()).withColumn("_d", diff)
        whole = Window.partitionBy(*self.keys)
        rows = rows.withColumns({"_mu": F.avg("_d").over(whole), "_sd": F.stddev_samp("_d").over(whole)})
        rows = rows.withColumn("_z", F.when(F.col("_sd") > 0, (F.col("_d") - F.col("_mu")) / F.col("_sd")).otherwise(F.col("_d") - F.col("_mu")))
        first = self.long_lags if self.shocks else []
        rows = self._lagged(rows, "_z", sorted({*self.lags, *first})).fillna(0.0, list(self.exog))
        if self.shocks:
            inputs = [*(f"_z{k}" for k in first), *self.exog]
            near, start, _ = self._least_squares(rows, inputs, spread=False)
            shock = " - ".join([f"_z - {_number(start)}", *(f"{_number(x)} * double({_name(c)})" for c, x in zip(inputs, near))])
            kept = dict.fromkeys([*self.keys, self.date, self.target, *self.exog, "_mu", "_sd", "_z", *(f"_z{k}" for k in self.lags)])
            rows = self._lagged(checkpointed(rows.select(*kept, F.expr(shock).alias("_e"))), "_e", self.shocks)
        names = [*(f"_z{k}" for k in self.lags), *(f"_e{k}" for k in self.shocks), *self.exog]
        coef, intercept, sigma = self._least_squares(rows, names)
        keep = max([*self.lags, *self.shocks, len(weights), 1])
        newest = Window.partitionBy(*self.keys).orderBy(F.desc(self.date))
        ends = rows.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= keep)
        last = (("_z", "_zs"), (self.target, "_ys"), *((("_e", "_es"),) if self.shocks else ()))
        state = ends.groupBy(*self.keys).agg(
            F.max(self.date).alias("_last"), F.first("_mu").alias("_mu"), F.first("_sd").alias("_sd"),
            *[F.array_sort(F.collect_list(F.struct(self.date, F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("v")))).getField("v").alias(n) for c, n in last],
        )
        return FittedSeasonalAr(self, checkpointed(state), dict(zip(names, coef)), intercept, sigma, weights)


@dataclass(frozen=True)
class FittedSeasonalAr:
    spec: SeasonalArForecaster
    state: DataFrame
    coef: dict[str, float]
    intercept: float
    sigma: float
    weights: list[float]

    def predict(self, future: DataFrame) -> DataFrame:
        """Recursive forecast of the future rows of each series, in date order. A series has one row per day and one
        horizon of them; they are forecast in one task. Shocks to come are taken to be 0."""
        s = self.spec
        exog = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in s.exog]) if s.exog else F.array().cast("array<double>")
        ahead = future.groupBy(*s.keys).agg(F.array_sort(F.collect_list(F.struct(F.col(s.date), exog.alias("x")))).alias("_days"))
        rows = ahead.join(self.state, list(s.keys), "left")
        keep = max([*s.lags, *s.shocks, len(self.weights), 1])

        def at(past: str, back: int) -> str:
            return f"coalesce(try_element_at(acc.{past}, -{back}), 0D)"

        # The step from day to day as SQL: one expression, where columns would be a hundred calls for each forecast.
        z = " + ".join([_number(self.intercept), *(f"{_number(self.coef.get(f'_z{k}', 0.0))} * {at('z', k)}" for k in s.lags),
                        *(f"{_number(self.coef.get(f'_e{k}', 0.0))} * {at('e', k)}" for k in s.shocks),
                        *(f"{_number(self.coef.get(c, 0.0))} * day.x[{i}]" for i, c in enumerate(s.exog))])
        y = " + ".join([f"({z}) * IF(_sd > 0, _sd, 1D)", "coalesce(_mu, 0D)",
                        *(f"{_number(c)} * {at('y', k)}" for k, c in enumerate(self.weights, 1) if c)])
        none = "CAST(array() AS array<double>)"  # a series unseen in training has no forecast
        past = {"z": ("_zs", z), "y": ("_ys", y), **({"e": ("_es", "0D")} if s.shocks else {})}
        start = ", ".join(f"'{n}', coalesce(CAST({c} AS array<double>), {none})" for n, (c, _) in past.items())
        moved = ", ".join(f"'{n}', slice(array_append(acc.{n}, {v}), greatest(size(acc.{n}) + 2 - {keep}, 1), {keep})" for n, (_, v) in past.items())
        n = F.size("_days")
        path = F.expr(f"""aggregate(_days, named_struct({start}, 'out', {none}),
            (acc, day) -> named_struct({moved}, 'out', array_append(acc.out, {y})), acc -> acc.out)""")
        path = F.when(F.col("_last").isNull(), F.array_repeat(F.lit(None).cast("double"), n)).otherwise(path)
        out = rows.select(*s.keys, F.col("_sd"), F.arrays_zip(F.col("_days").getField(s.date).alias("d"), path.alias("y")).alias("_p"))
        out = out.select(*s.keys, "_sd", F.posexplode("_p").alias("_i", "_r"))
        half = NormalDist().inv_cdf(1 - s.alpha / 2) * self.sigma if 0 < s.alpha < 2 else None
        wide = F.lit(half).cast("double") * F.coalesce("_sd", F.lit(0.0)) * F.sqrt(F.col("_i") + 1.0)
        return out.select(*s.keys, F.col("_r")["d"].alias(s.date), F.col("_r")["y"].alias("yhat"),
                          (F.col("_r")["y"] - wide).alias("yhat_lower"), (F.col("_r")["y"] + wide).alias("yhat_upper"))

    transform = predict

    def save(self, path: str) -> None:
        numbers = {"coef": self.coef, "intercept": self.intercept, "sigma": self.sigma, "weights": self.weights}
        _save(path, "seasonal_ar", self.spec, numbers, {"series": self.state})

    @staticmethod
    def load(path: str) -> FittedSeasonalAr:
        spec, state, tables = _load(path, SeasonalArForecaster, ["series"])
        return FittedSeasonalAr(spec, tables["series"], **state)


# --- trend and seasonality ------------------------------------------------------------------


@dataclass(frozen=True)
class TrendSeasonalityForecaster:
    """Trend, weekly and annual cycles, holidays and regressors on the log scale, around each series' level.

    Cycles and a common trend are fitted over all series. On top each series has a trend of its own, by least squares
    on what the common fit leaves over, drawn towards none by as much as chance alone would make trends differ.
    """

    regressors: tuple[str, ...] = ()
    weekly_order: int = 3
    annual_order: int = 10
    reg_param: float = 0.1
    target: str = TARGET
    keys: tuple[str, ...] = KEYS
    date: str = DATE

    def _terms(self, df: DataFrame, origin, span: int) -> tuple[DataFrame, list[str]]:
        t = F.datediff(F.col(self.date), F.lit(origin))
        terms = {"_t": t / float(span), **fourier(t, 7.0, self.weekly_order, "_week"), **fourier(t, 365.25, self.annual_order, "_year")}
        out = add_holidays(df.withColumns(terms), None, self.date, prefix="_h_")
        out = out.withColumns({"_holiday": F.col("_h_is_holiday").cast("double"),
                               **{f"_r_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.regressors}})
        return out, [*terms, "_holiday", *(f"_r_{c}" for c in self.regressors)]

    def fit(self, train: DataFrame) -> FittedTrendSeasonality:
        train = train.where(F.col(self.target).isNotNull())
        first, last = train.agg(F.min(self.date), F.max(self.date)).first()
        span = max((last - first).days, 1)
        rows, names = self._terms(train, first, span)
        logy = F.log1p(F.greatest(F.col(self.target).cast("double"), F.lit(0.0)))
        levels = train.groupBy(*self.keys).agg(F.avg(logy).alias("_level"))
        rows = rows.withColumn("_ly", logy - F.avg(logy).over(Window.partitionBy(*self.keys)))
        data = VectorAssembler(inputCols=names, outputCol="_v").transform(rows.select("_ly", *names))
        lr = LinearRegression(featuresCol="_v", labelCol="_ly", predictionCol="_p", regParam=self.reg_param).fit(data)
        left = checkpointed(lr.transform(VectorAssembler(inputCols=names, outputCol="_v").transform(rows)).select(*self.keys, "_t", (F.col("_ly") - F.col("_p")).alias("_r")))
        own = series_slopes(left, "_r", "_t", self.keys, shrink=chance_shrinkage(left, "_r", "_t", self.keys))
        levels = checkpointed(levels.join(own.select(*self.keys, "slope", "mean_x"), list(self.keys)))
        resid = left.join(levels, list(self.keys)).select((F.col("_r") - F.col("slope") * (F.col("_t") - F.col("mean_x"))).alias("r"))
        low, high = exact_quantiles(resid, ["r"], [0.1, 0.9])["r"]
        means = rows.agg(*[F.avg(c).alias(c) for c in names]).first().asDict()
        return FittedTrendSeasonality(self, lr, levels, first, span, low, high, means)


def series_slopes(df: DataFrame, y: str, x: str, keys: Sequence[str] = KEYS, shrink: float = 0.0) -> DataFrame:
    """(keys, n, slope, intercept, mean_x): least squares of ``y`` on ``x`` for each series from sums of products, which
    are added up before they move. ``shrink`` is added to the sum of squares of ``x``; inf means no slopes."""
    y, x = (F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c).cast("double")) for c in (y, x))
    sums = df.groupBy(*keys).agg(F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("_xx"), F.regr_sxy(y, x).alias("_xy"), F.regr_avgx(y, x).alias("mean_x"), F.regr_avgy(y, x).alias("_y"))
    slope = F.lit(0.0) if shrink == float("inf") else F.when(F.col("_xx") + shrink > 0, F.col("_xy") / (F.col("_xx") + shrink)).otherwise(0.0)
    sums = sums.withColumn("slope", F.when(F.col("n") > 0, slope))
    return sums.select(*keys, "n", "slope", (F.col("_y") - F.col("slope") * F.col("mean_x")).alias("intercept"), "mean_x")


def chance_shrinkage(df: DataFrame, y: str, x: str, keys: Sequence[str] = KEYS) -> float:
    """How strongly to draw slopes towards 0: the variance of a row over that of the true slopes (moments of all series)."""
    y, x = F.col(y).cast("double"), F.col(x).cast("double")
    sums = df.groupBy(*keys).agg(F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("xx"), F.regr_sxy(y, x).alias("xy"), F.regr_syy(y, x).alias("yy")).where("xx > 0 and n > 2")
    raw = F.col("xy") / F.col("xx")
    rest = sums.agg(F.sum(F.col("yy") - raw * F.col("xy")), F.sum(F.col("n") - 2)).first()
    if not rest[1]:
        return float("inf")
    noise = max(float(rest[0]) / float(rest[1]), 0.0)
    spread = sums.agg(F.avg(raw * raw - noise / F.col("xx"))).first()[0]
    if noise == 0.0:
        return 0.0
    return noise / float(spread) if spread > 0 else float("inf")


@dataclass(frozen=True)
class FittedTrendSeasonality:
    spec: TrendSeasonalityForecaster
    model: object
    levels: DataFrame
    origin: object
    span: int
    low: float
    high: float
    means: dict[str, float]

    def predict(self, future: DataFrame) -> DataFrame:
        rows, names = self.spec._terms(future, self.origin, self.span)
        scored = self.model.transform(VectorAssembler(inputCols=names, outputCol="_v").transform(rows))
        scored = scored.join(self.levels, list(self.spec.keys), "left")
        z = F.col("_p") + F.coalesce("_level", F.lit(0.0)) + self._own_trend()
        back = {"yhat": F.expm1(z), "yhat_lower": F.expm1(z + self.low), "yhat_upper": F.expm1(z + self.high)}
        return scored.select(*future.columns, *[F.greatest(c, F.lit(0.0)).alias(n) for n, c in back.items()])

    transform = predict

    def _own_trend(self) -> Column:
        return F.coalesce(F.col("slope") * (F.col("_t") - F.col("mean_x")), F.lit(0.0))

    def contributions(self, future: DataFrame) -> DataFrame:
        """(keys, date, feature, contribution) on the log scale, around the series' level; ``_own_trend`` is the series' own."""
        rows, names = self.spec._terms(future, self.origin, self.span)
        rows = rows.join(self.levels, list(self.spec.keys), "left").withColumn("_own_trend", self._own_trend())
        weights = {**dict(zip(names, map(float, self.model.coefficients))), "_own_trend": 1.0}
        return linear_contributions(weights, rows, (*self.spec.keys, self.spec.date), {**self.means, "_own_trend": 0.0})

    def save(self, path: str) -> None:
        _save(path, "trend_seasonality", self.spec, {"origin": str(self.origin), "span": self.span, "low": self.low, "high": self.high, "means": self.means},
              {"levels": self.levels})
        self.model.write().overwrite().save(f"{path}/model")

    @staticmethod
    def load(path: str) -> FittedTrendSeasonality:
        spec, state, tables = _load(path, TrendSeasonalityForecaster, ["levels"])
        model = LinearRegressionModel.load(f"{path}/model")
        return FittedTrendSeasonality(spec, model, tables["levels"], dt.date.fromisoformat(state["origin"]), state["span"], state["low"], state["high"], state["means"])


# --- stored models --------------------------------------------------------------------------


def _save(path: str, kind: str, spec, state: dict, tables: dict[str, DataFrame]) -> None:
    """Settings and numbers as one row of JSON beside the tables, all in one folder."""
    spark = next(iter(tables.values())).sparkSession
    settings = {f.name: getattr(spec, f.name) for f in fields(spec) if not is_dataclass(getattr(spec, f.name))}
    spark.createDataFrame([(kind, json.dumps(settings), json.dumps(state))], "kind string, settings string, state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def _tuples(v):
    return tuple(map(_tuples, v)) if isinstance(v, list) else v


def _load(path: str, spec_class, tables: Sequence[str]) -> tuple[object, dict, dict[str, DataFrame]]:
    spark = SparkSession.active()
    row = spark.read.parquet(f"{path}/about").first()
    spec = spec_class(**{k: _tuples(v) for k, v in json.loads(row.settings).items()})
    return spec, json.loads(row.state), {t: spark.read.parquet(f"{path}/{t}") for t in tables}


def load_fitted(spark: SparkSession, path: str):
    """A fitted model of any kind from the folder that its ``save`` wrote."""
    kind = spark.read.parquet(f"{path}/about").first().kind
    return {"gbt": FittedGbt, "quantile": FittedQuantile, "seasonal_ar": FittedSeasonalAr, "trend_seasonality": FittedTrendSeasonality}[kind].load(path)


# --- any model per series -------------------------------------------------------------------


def per_series(df: DataFrame, fn, schema: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Custom model per series: ``fn`` gets one series as a pandas frame. A series is bounded by its days."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
