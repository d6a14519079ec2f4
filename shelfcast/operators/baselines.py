"""Baseline forecasts: each gives ``horizon`` days after the last date of every series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.series import linear_recurrence, series_window
from shelfcast.panel import Panel


def _latest_rows(panel: Panel, n: int) -> DataFrame:
    """The last ``n`` known rows per series; limited on the map side before the shuffle."""
    w = Window.partitionBy(*panel.keys).orderBy(F.desc(panel.date))
    known = panel.df.where(F.col(panel.target).isNotNull()).select(*panel.keys, panel.date, panel.target)
    return known.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n)


def _ahead(per_series: DataFrame, panel: Panel, horizon: int, name: str) -> DataFrame:
    """One row per series with ``_last`` and the value, spread over the days ahead."""
    days = F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))
    return per_series.select(*panel.keys, F.explode(days).alias(panel.date), F.col("_value").alias(panel.target),
                             F.lit(name).alias("forecast_type"))


def naive(panel: Panel, horizon: int = 28) -> DataFrame:
    """The last value repeated."""
    known = panel.df.where(F.col(panel.target).isNotNull())
    last = known.groupBy(*panel.keys).agg(F.max_by(panel.target, panel.date).cast("double").alias("_value"),
                                          F.max(panel.date).alias("_last"))
    return _ahead(last, panel, horizon, "naive")


def seasonal_naive(panel: Panel, horizon: int = 28, period: int = 7) -> DataFrame:
    """The last ``period`` values in turn; series shorter than that repeat their last value."""
    w = Window.partitionBy(*panel.keys)
    rows = _latest_rows(panel, period).withColumns({"_n": F.count("*").over(w), "_last": F.max(panel.date).over(w)})
    place = F.when(F.col("_n") == period, F.lit(period) - F.col("_back")).when(F.col("_back") == 1, 0)
    step = F.when(F.col("_n") == period, period).otherwise(1)
    rows = rows.withColumns({"_at": place, "_step": step}).where(F.col("_at") < horizon)
    steps = F.sequence(F.col("_at"), F.lit(horizon - 1), F.col("_step"))
    return rows.withColumn("_j", F.explode(steps)).select(
        *panel.keys, F.date_add("_last", F.col("_j") + 1).alias(panel.date), F.col(panel.target).cast("double"),
        F.lit("seasonal_naive").alias("forecast_type"),
    )


def moving_average(panel: Panel, horizon: int = 28, window: int = 7) -> DataFrame:
    """The mean of the last ``window`` values repeated."""
    mean = _latest_rows(panel, window).groupBy(*panel.keys).agg(F.avg(panel.target).alias("_value"), F.max(panel.date).alias("_last"))
    return _ahead(mean, panel, horizon, "moving_average")


def exponential_smoothing(panel: Panel, horizon: int = 28, alpha: float = 0.3) -> DataFrame:
    """The final level of simple exponential smoothing started at the first value.

    The level is a weighted sum with weights known from the position, so it is a plain aggregate.
    """
    w = Window.partitionBy(*panel.keys)
    known = panel.df.where(F.col(panel.target).isNotNull())
    rows = known.select(*panel.keys, panel.date, panel.target,
                        (F.row_number().over(w.orderBy(panel.date)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    back = F.pow(F.lit(1 - alpha), (F.col("_n") - 1 - F.col("_i")).cast("double"))
    weight = F.when(F.col("_i") == 0, back).otherwise(alpha * back)
    level = rows.groupBy(*panel.keys).agg(F.sum(weight * F.col(panel.target)).alias("_value"), F.max(panel.date).alias("_last"))
    return _ahead(level, panel, horizon, "exponential_smoothing")


# The baselines by name.
BASELINES = {
    "naive": naive,
    "seasonal_naive": seasonal_naive,
    "moving_average": moving_average,
    "exponential_smoothing": exponential_smoothing,
}
PERIOD, WINDOW, ALPHA = 7, 7, 0.3


def final_state(target: str, date: str, back: str) -> dict[str, Column]:
    """Aggregates over the known rows of a series that hold all four baselines; ``back`` counts from the newest."""
    x, b = F.col(target).cast("double"), F.col(back)
    # The first value enters with the full weight of everything before it.
    start = F.pow(F.lit(1 - ALPHA), F.count(b).cast("double")) * F.min_by(x, F.col(date))
    return {
        "_last": F.max(date),
        "_n": F.count(b),
        "_mean": F.avg(F.when(b <= WINDOW, x)),
        "_level": F.sum(ALPHA * F.pow(F.lit(1 - ALPHA), (b - 1).cast("double")) * x) + start,
        **{f"_v{i}": F.max(F.when(b == i, x)) for i in range(1, PERIOD + 1)},
    }


def running_state(panel: Panel) -> DataFrame:
    """Panel rows with, in ``_state``, what ``final_state`` would hold if the series ended there; null where the target is.

    ``_next`` is the date of the next known row. Known rows are numbered among themselves inside the partitions of the
    series, so this is one shuffle.
    """
    x, n = F.col("_x"), F.col("_n")
    rows = panel.df.select(*panel.keys, panel.date, panel.target, F.col(panel.target).cast("double").alias("_x"))
    # This window deals the rows out by series; those below find them in place.
    seen = series_window(panel.keys, panel.date).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_n": F.count(x).over(seen), "_known": x.isNotNull()})
    own = [*panel.keys, "_known"]
    rows = linear_recurrence(rows, own, panel.date, n, 1 - ALPHA, {"_level": F.when(n == 1, x).otherwise(ALPHA * x)}, 1 - ALPHA)
    w = Window.partitionBy(*own).orderBy(panel.date)
    rows = rows.withColumns({
        "_last": F.col(panel.date), "_next": F.lead(panel.date).over(w),
        "_mean": F.avg(x).over(w.rowsBetween(1 - WINDOW, 0)), "_v1": x,
        **{f"_v{i}": F.lag(x, i - 1).over(w) for i in range(2, PERIOD + 1)},
    })
    names = ["_last", "_n", "_mean", "_level", *(f"_v{i}" for i in range(1, PERIOD + 1))]
    return rows.select(*panel.keys, panel.date, panel.target, F.when(F.col("_known"), F.struct(*names)).alias("_state"), "_next")


def forecasts_at(step: Column) -> dict[str, Column]:
    """Forecast of each baseline ``step`` days (from 0) after the last date, from the columns of ``final_state``."""
    cycle = F.lit(None).cast("double")
    for i in range(1, PERIOD + 1):
        cycle = F.when(step % PERIOD == PERIOD - i, F.col(f"_v{i}")).otherwise(cycle)
    return {
        "naive": F.col("_v1"),
        "seasonal_naive": F.when(F.col("_n") >= PERIOD, cycle).otherwise(F.col("_v1")),
        "moving_average": F.col("_mean"),
        "exponential_smoothing": F.col("_level"),
    }


def by_name(forecasts: dict[str, Column], names: Sequence[str], label: str, value: str) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(n).alias(label), forecasts[n].alias(value)) for n in names]))


def all_baselines(panel: Panel, horizon: int = 28, names: Sequence[str] = tuple(BASELINES)) -> DataFrame:
    """All baselines from one pass over the panel and one shuffle."""
    w = Window.partitionBy(*panel.keys).orderBy(F.desc(panel.date))
    known = panel.df.where(F.col(panel.target).isNotNull()).select(*panel.keys, panel.date, panel.target)
    ranked = known.withColumn("_back", F.row_number().over(w))
    state = ranked.groupBy(*panel.keys).agg(*[c.alias(n) for n, c in final_state(panel.target, panel.date, "_back").items()])
    steps = state.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    rows = steps.select(*panel.keys, F.date_add("_last", F.col("_j") + 1).alias(panel.date),
                        by_name(forecasts_at(F.col("_j")), names, "forecast_type", panel.target).alias("_f"))
    return rows.select(*panel.keys, panel.date, f"_f.{panel.target}", "_f.forecast_type")


def one_step_naive(panel: Panel, out: str = "yhat") -> DataFrame:
    """The value of the day before; the series mean where there is none."""
    w = series_window(panel.keys, panel.date)
    mean = F.avg(panel.target).over(Window.partitionBy(*panel.keys))
    return panel.df.withColumn(out, F.coalesce(F.lag(panel.target).over(w), mean))
