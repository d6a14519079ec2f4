"""Cleaning: deduplicate, cap, fill the calendar, impute, flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.config import DATE, KEYS
from shelfcast.functions.series import fill_backward, fill_forward, newest_first, series_window
from shelfcast.operators.quantiles import exact_quantiles, iqr_bounds, outside
from shelfcast.operators.validate import validate_clean

MEASURES = ("sales", "price", "temperature", "precipitation")


def drop_duplicates(df: DataFrame, keys: Sequence[str] = KEYS, date: str = DATE, order_by: Sequence = ()) -> DataFrame:
    """One row per (series, date): the first in ``order_by``, then in the order of the other columns.

    An exact copy shares its key, so this drops those too. Row-number <= 1 is limited on the map
    side before the shuffle, so a key with very many copies sends one row per task.
    """
    key = [date, *keys]
    ties = [F.col(c) for c in df.columns if c not in key and not df.schema[c].dataType.typeName().startswith("map")]
    w = Window.partitionBy(*key).orderBy(*order_by, *ties) if (order_by or ties) else Window.partitionBy(*key).orderBy(*key)
    return df.withColumn("_copy", F.row_number().over(w)).where("_copy = 1").drop("_copy")


def cap_outliers(df: DataFrame, columns: Sequence[str] = MEASURES, k: float = 1.5,
                 bounds: dict | None = None) -> DataFrame:
    """Clamp each column to its whole-table interquartile fences; the fences are literals in the plan."""
    columns = [c for c in columns if c in df.columns]
    bounds = bounds or iqr_bounds(df, columns, k)
    capped = {}
    for c in columns:
        if bounds.get(c):
            lo, hi = bounds[c]
            capped[c] = F.when(F.col(c) < lo, lo).when(F.col(c) > hi, hi).otherwise(F.col(c).cast("double"))
    return df.withColumns(capped) if capped else df


def fill_calendar_gaps(df: DataFrame, keys: Sequence[str] = KEYS, date: str = DATE, start=None, end=None) -> DataFrame:
    """One row per day and series between the first and last date of the whole table.

    Each row spans the days up to the next row of its series and is exploded over them, so this
    needs one shuffle on the series keys, which later per-series windows reuse, and no join.
    """
    if start is None or end is None:
        first, last = df.agg(F.min(date), F.max(date)).first()
        start, end = start or first, end or last
    if start is None:
        return df
    w = series_window(keys, date)
    since = F.when(F.lag(date).over(w).isNull(), F.lit(start)).otherwise(F.col(date))
    after = F.lead(date).over(w)
    until = F.when(after.isNull(), F.lit(end)).otherwise(F.greatest(F.col(date), F.date_sub(after, 1)))
    spans = df.withColumns({"_since": since, "_until": until})
    days = spans.withColumn("_day", F.explode(F.sequence("_since", "_until")))
    own = F.col("_day") == F.col(date)
    return days.select(
        *[F.col("_day").alias(c) if c == date else F.col(c) if c in keys else F.when(own, F.col(c)).alias(c) for c in df.columns]
    )


def impute_sales(df: DataFrame, column: str = "sales", keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    """Carry the last known value forward, then the next one back, within the series."""
    w = series_window(keys, date)
    return df.withColumn(column, F.coalesce(fill_forward(F.col(column), w), fill_backward(F.col(column), newest_first(keys, date))))


def impute_median(df: DataFrame, columns: Sequence[str] = ("price", "temperature", "precipitation"),
                  medians: dict | None = None) -> DataFrame:
    columns = [c for c in columns if c in df.columns]
    if medians is None:
        medians = {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items() if v}
    return df.fillna({c: medians[c] for c in columns if c in medians}) if medians else df


def impute_defaults(df: DataFrame) -> DataFrame:
    defaults = {c: v for c, v in {"on_promo": 0, "holiday_name": ""}.items() if c in df.columns}
    return df.fillna(defaults) if defaults else df


def add_cleaning_flags(df: DataFrame, bounds: tuple[float, float] | None = None) -> DataFrame:
    """``is_missing`` and ``is_outlier`` of sales; bounds default to those of the table given."""
    if "sales" not in df.columns:
        return df.withColumns({"is_outlier": F.lit(False), "is_missing": F.lit(False)})
    bounds = bounds or iqr_bounds(df, ["sales"])["sales"]
    return df.withColumns({"is_outlier": outside("sales", bounds), "is_missing": F.col("sales").isNull()})


def clean(
    df: DataFrame,
    remove_duplicates: bool = True,
    handle_outliers: bool = True,
    reindex: bool = True,
    impute: bool = False,
    strict: bool = False,
    order_by: Sequence = (),
) -> DataFrame:
    """Parse the date, then deduplicate, cap, fill the calendar, impute (optional), flag and check.

    ``is_outlier`` marks the values that were capped; ``is_missing`` marks days without sales after
    filling (none are left when imputing). The deduplicated rows are read several times (fences,
    period, checks), so they are kept meanwhile; the result is a plain table that keeps nothing.
    """
    df = df.withColumn(DATE, F.to_date(DATE))
    columns = [c for c in MEASURES if c in df.columns]
    if remove_duplicates:
        df = drop_duplicates(df, order_by=order_by)
    rows = df.persist()
    try:
        return _cleaned(rows, columns, handle_outliers, reindex, impute, strict)
    finally:
        rows.unpersist()


def _cleaned(df: DataFrame, columns: list[str], handle_outliers: bool, reindex: bool, impute: bool, strict: bool) -> DataFrame:
    bounds = iqr_bounds(df, columns if handle_outliers else [c for c in columns if c == "sales"])
    flag = outside("sales", bounds["sales"]) if "sales" in columns else F.lit(False)
    df = df.withColumn("is_outlier", flag)
    if handle_outliers:
        df = cap_outliers(df, columns, bounds=bounds)
    if reindex:
        df = fill_calendar_gaps(df).fillna({"is_outlier": False})
    if impute:
        df = impute_defaults(impute_median(impute_sales(df) if "sales" in columns else df))
    missing = F.col("sales").isNull() if "sales" in df.columns else F.lit(False)
    df = df.withColumn("is_missing", missing)
    validate_clean(df, strict=strict)
    return df


def cleaning_summary(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(metric, value) rows: row counts before and after, nulls per column, flags set."""

    def counts(df: DataFrame, label: str) -> DataFrame:
        flags = [F.count_if(F.col(c)).alias(f"{c}_flagged") for c in ("is_outlier", "is_missing") if c in df.columns]
        row = df.agg(F.count("*").alias(f"rows_{label}"),
                     *[F.count_if(F.col(c).isNull()).alias(f"nulls_{label}_{c}") for c in df.columns], *flags)
        return row.unpivot([], row.columns, "metric", "value")

    both = counts(original, "original").unionByName(counts(cleaned, "cleaned"))
    signed = F.when(F.col("metric") == "rows_original", F.col("value")).when(F.col("metric") == "rows_cleaned", -F.col("value"))
    removed = both.agg(F.sum(signed).alias("value")).select(F.lit("rows_removed").alias("metric"), "value")
    return both.unionByName(removed)
