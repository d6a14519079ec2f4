"""Drift between two tables of the same shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.quantiles import exact_quantiles, long_form

FEATURES = ("sales", "price", "on_promo")
# Alert thresholds.
ALERT, PSI_HIGH, PSI_MODERATE, MISSING_HIGH = 0.2, 0.2, 0.1, 0.1


def _sides(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.withColumn("_new", F.lit(0)).unionByName(actual.withColumn("_new", F.lit(1)))


def _psi(counts: DataFrame, by: str) -> DataFrame:
    """From (by, cell, e, a) counts with all rows present, cells outside any bin as null."""
    total = counts.groupBy(by).agg(F.sum("e").alias("ne"), F.sum("a").alias("na"))
    pe, pa = F.try_divide("e", "ne"), F.try_divide("a", "na")
    term = F.when((F.col("e") > 0) & (F.col("a") > 0) & F.col("cell").isNotNull(), (pa - pe) * F.ln(F.try_divide(pa, pe)))
    return counts.join(total, by).groupBy(by).agg(F.greatest(F.coalesce(F.sum(term), F.lit(0.0)), F.lit(0.0)).alias("psi"))


def bin_edges(expected: DataFrame, columns: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    q = exact_quantiles(expected, columns, [min(1.0, i * (1.0 / bins)) for i in range(bins + 1)])
    return {c: sorted(set(v)) if v else [] for c, v in q.items()}


def _cell(x: Column, edges: Sequence[float]) -> Column:
    """Half-open bins, the last one closed; null outside. The first bin whose upper edge is above the value."""
    out = F.when(x < edges[0], F.lit(None)) if edges else F.when(F.lit(True), F.lit(None))
    for i, edge in enumerate(edges[1:]):
        out = out.when((x <= edge) if i == len(edges) - 2 else (x < edge), i)
    return out


def psi_numeric(expected: DataFrame, actual: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, psi): population stability over quantile bins of ``expected``.

    The bins are a dozen literals per feature, so both tables are counted in one pass with
    partial aggregation. Values outside the bins stay in the denominators.
    """
    columns = list(columns)
    edges = bin_edges(expected, columns, bins)
    both = _sides(*[d.select(*[F.col(c).cast("double").alias(c) for c in columns]) for d in (expected, actual)])
    long = both.unpivot(["_new"], columns, "feature", "value").where("value is not null")
    cell = F.lit(None)
    for c in columns:
        cell = F.when(F.col("feature") == c, _cell(F.col("value"), edges[c])).otherwise(cell)
    counts = long.groupBy("feature", cell.cast("int").alias("cell")).agg(
        F.count_if(F.col("_new") == 0).alias("e"), F.count_if(F.col("_new") == 1).alias("a")
    )
    return _psi(counts, "feature")


def psi_categorical(expected: DataFrame, actual: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, psi) over value shares; only values present on both sides count."""
    both = _sides(*[d.select(*[F.col(c).cast("string").alias(c) for c in columns]) for d in (expected, actual)])
    long = both.unpivot(["_new"], list(columns), "feature", "cell").where("cell is not null")
    counts = long.groupBy("feature", "cell").agg(F.count_if(F.col("_new") == 0).alias("e"), F.count_if(F.col("_new") == 1).alias("a"))
    return _psi(counts, "feature")


def _changes(new: DataFrame, historical: DataFrame, moments: dict[str, str], missing: Sequence[str]) -> DataFrame:
    """(metric, value) rows from one pass over both tables: a single row of conditional aggregates, then unpivoted.

    ``moments`` maps columns to the names their metrics start with.
    """
    needed = list(dict.fromkeys([*moments, *missing]))
    both = _sides(historical.select(*needed), new.select(*needed))
    old, now = F.col("_new") == 0, F.col("_new") == 1
    aggs = [F.count_if(old).alias("n0"), F.count_if(now).alias("n1")]
    out = {}
    for c, name in moments.items():
        for kind, f in (("mean", F.avg), ("std", F.stddev_samp)):
            a, b = f"{c}_{kind}_0", f"{c}_{kind}_1"
            x = F.col(c).cast("double")
            aggs += [f(F.when(old, x)).alias(a), f(F.when(now, x)).alias(b)]
            out[f"{name}_{kind}_drift"] = F.when(F.col(a) > 0, F.abs(F.col(b) - F.col(a)) / F.col(a)).otherwise(0.0)
    for c in missing:
        gone = F.col(c).isNull()
        aggs += [F.count_if(old & gone).alias(f"{c}_null_0"), F.count_if(now & gone).alias(f"{c}_null_1")]
        share = [F.try_divide(F.col(f"{c}_null_{i}"), F.col(f"n{i}")) for i in (0, 1)]
        out[f"{c}_missing_drift"] = F.abs(share[1] - share[0])
    row = both.agg(*aggs).where("n0 > 0 and n1 > 0").select(*[v.cast("double").alias(k) for k, v in out.items()])
    return row.unpivot([], list(out), "metric", "value")


def moment_drift(new: DataFrame, historical: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """(metric, value) rows: relative change of mean and standard deviation; 0 where the old one is not positive."""
    return _changes(new, historical, {c: c for c in columns if c in new.columns and c in historical.columns}, [])


def missing_drift(new: DataFrame, historical: DataFrame) -> DataFrame:
    """(metric, value) rows: change of the share of nulls in every column both tables have."""
    return _changes(new, historical, {}, [c for c in new.columns if c in historical.columns])


def prediction_drift(new: DataFrame, historical: DataFrame) -> DataFrame:
    """Moment drift of ``yhat``; no rows if either table is empty."""
    return _changes(new, historical, {"yhat": "prediction"}, [])


def data_drift(new: DataFrame, historical: DataFrame, columns: Sequence[str] = FEATURES, bins: int = 10) -> DataFrame:
    """All (metric, value) rows for a new batch against history."""
    columns = [c for c in columns if c in new.columns and c in historical.columns]
    psi = psi_numeric(historical, new, columns, bins).select(F.concat("feature", F.lit("_psi")).alias("metric"), F.col("psi").alias("value"))
    shared = [c for c in new.columns if c in historical.columns]
    return psi.unionByName(_changes(new, historical, {c: c for c in columns}, shared))


def drift_alerts(metrics: DataFrame, threshold: float = ALERT) -> DataFrame:
    """Metrics that call for attention, with a severity."""
    m, v = F.col("metric"), F.col("value")
    severity = (
        F.when(m.endswith("_psi") & (v > PSI_HIGH), "significant")
        .when(m.endswith("_psi") & (v > PSI_MODERATE), "moderate")
        .when(m.endswith("_missing_drift") & (v > MISSING_HIGH), "missing_data")
        .when(v > threshold, "drift")
    )
    return metrics.withColumns({"severity": severity, "over_threshold": v > threshold}).where(severity.isNotNull())
