"""What drives a forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.config import DATE, KEYS, TARGET
from shelfcast.functions.ranking import checkpointed, rank_within
from shelfcast.operators.scoring import FEATURES


def _top(long: DataFrame, ids: Sequence[str], value: str, k: int) -> DataFrame:
    w = Window.partitionBy(*ids).orderBy(F.desc(F.abs(value)), "feature")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def explain_simple(df: DataFrame, k: int = 10, columns: Sequence[str] = FEATURES, ids: Sequence[str] = (*KEYS, DATE)) -> DataFrame:
    """The ``k`` inputs of largest magnitude for each forecast row; rows with the same ids count as one.

    Each row is cut to its own ``k`` inputs, as places in the order of names, before it moves. So one narrow row is
    shuffled and sorted for each row given, however many inputs there are.
    """
    ids, names, k = list(ids), sorted(columns), max(k, 0)
    # Places are negative, so that of equal values the first name is the largest.
    cells = [F.struct(F.abs(F.col(c).cast("double")).alias("v"), F.lit(-i).cast("short").alias("f")) for i, c in enumerate(names)]

    def largest(cells: Column) -> Column:
        return F.slice(F.sort_array(cells, asc=False), 1, k)

    cut = df.select(*ids, largest(F.array(*cells)).alias("_top"))
    cut = cut.select(*ids, *[F.col("_top").getField(n).alias(f"_{n}") for n in "vf"])
    # Of rows with equal ids, those whose largest inputs lead hold the largest of all: k rows at most are looked at together.
    order = Window.partitionBy(*ids).orderBy(F.desc(F.get("_v", F.lit(0))), F.desc(F.get("_f", F.lit(0))))
    lead = order.rowsBetween(Window.currentRow, max(k - 1, 0))
    one = cut.select(*ids, *[F.collect_list(f"_{n}").over(lead).alias(n) for n in "vf"], F.row_number().over(order).alias("_n")).where(F.col("_n") == 1)
    cut = one.select(*ids, F.posexplode(largest(F.arrays_zip(*[F.flatten(n).alias(n) for n in "vf"]))).alias("_i", "_c"))
    feature = F.element_at(F.array(*[F.lit(c) for c in names]), 1 - F.col("_c")["f"])
    return cut.select(*ids, feature.alias("feature"), F.col("_c")["v"].alias("importance"), (F.col("_i") + 1).alias("rank"))


def linear_contributions(coefficients: dict[str, float], df: DataFrame, ids: Sequence[str] = (*KEYS, DATE),
                         means: dict[str, float] | None = None) -> DataFrame:
    """(ids, feature, contribution) of a linear model: coefficient times distance from the mean, exact.

    ``means`` are those of the training rows; without them, those of ``df`` are taken.
    """
    names = list(coefficients)
    if means is None:
        means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names]).first().asDict()
    parts = {c: (F.col(c).cast("double") - float(means[c] or 0.0)) * float(coefficients[c]) for c in names}
    wide = df.select(*ids, *[v.alias(c) for c, v in parts.items()])
    return wide.unpivot(list(ids), names, "feature", "contribution")


def tree_importance(model, columns: Sequence[str]) -> DataFrame:
    """(feature, importance) of a fitted tree ensemble, largest first."""
    from pyspark.sql import SparkSession

    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def explain_contributions(contributions: DataFrame, k: int = 10, ids: Sequence[str] = (*KEYS, DATE)) -> DataFrame:
    """The ``k`` largest signed contributions by magnitude per forecast row."""
    return _top(contributions, ids, "contribution", k)


def mean_abs_contribution(contributions: DataFrame, n: int = 20) -> DataFrame:
    mean = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    return mean.orderBy(F.desc("mean_abs"), "feature").limit(n)


def permutation_importance(model, df: DataFrame, features: Sequence[str], target: str = TARGET, ids: Sequence[str] = (*KEYS, DATE),
                           seed: int = 42) -> DataFrame:
    """(feature, rmse, importance): how far the error grows when one feature is taken from another row.

    Rows stand in the order of a hash of their ids and ``seed``; each takes the value of the next one, the last that of
    the first. Ranks and donors cost one sort and one join however many features there are, and all features are scored
    in one pass. ``ids`` must tell rows apart; rows without target or forecast do not count. Needs no knowledge of the model.
    """
    known = df.where(F.col(target).isNotNull())
    ranked = checkpointed(rank_within(known.withColumn("_hash", F.md5(F.concat_ws("_", F.lit(str(seed)), *ids))), [], ["_hash", *ids], "_rank"))
    n = ranked.count()
    if not n:
        raise ValueError("no rows with a target")
    donors = ranked.select(F.pmod(F.col("_rank") - 1, F.lit(n)).alias("_rank"), F.struct(*features).alias("_donor"))
    both = ranked.drop("_hash").join(donors, "_rank")
    names = F.array(F.lit(None).cast("string"), *[F.lit(c) for c in features])
    tried = both.withColumn("_feature", F.explode(names))
    tried = tried.withColumns({c: F.when(F.col("_feature") == c, F.col("_donor")[c]).otherwise(F.col(c)) for c in features}).drop("_donor", "_rank")
    error = F.col(target) - F.col("yhat")
    rmse = model.predict(tried).groupBy(F.col("_feature").alias("feature")).agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    base = rmse.where("feature is null").select("rmse").scalar()
    return rmse.withColumn("importance", F.col("rmse") - base).where("feature is not null").orderBy(F.desc("importance"), "feature")
