"""Checks on panels and request tables. Whole-table checks take one aggregate and raise."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.config import DATE, KEYS
from shelfcast.panel import Panel

log = logging.getLogger(__name__)

RAW_COLUMNS = ("date", "store_id", "item_id", "sales", "on_promo")


def require_columns(df: DataFrame, columns: Sequence[str], date_columns: Sequence[str] = ()) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks the columns {missing}")
    dates = [c for c in date_columns if c in df.columns]
    if dates:
        bad = date_violations(df, dates).first()
        for c in dates:
            if bad[c]:
                raise ValueError(f"Column {c} holds {bad[c]} values that are not dates")


def date_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: per column, how many values are there but are no dates."""
    return df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("date").isNull()).alias(c) for c in columns])


def _bad_flag(c: str, null_ok: bool = False) -> Column:
    ok = F.col(c).isin(0, 1)
    return ~F.coalesce(ok, F.lit(null_ok))


def raw_violations(df: DataFrame) -> DataFrame:
    """One row: values of sales that are no numbers or negative, and promotion flags that are neither 0 nor 1."""
    sales = F.col("sales").try_cast("double")
    return df.agg(F.count_if(F.col("sales").isNotNull() & sales.isNull()).alias("n_text"), F.count_if(sales < 0).alias("n_negative"),
                  F.count_if(_bad_flag("on_promo")).alias("n_promo"))


def validate_raw(df: DataFrame) -> None:
    require_columns(df, RAW_COLUMNS)
    s = raw_violations(df).first()
    if s.n_text:
        raise ValueError(f"sales holds {s.n_text} values that are not numbers")
    if s.n_negative:
        raise ValueError("sales holds negative values")
    if s.n_promo:
        raise ValueError(f"on_promo must be 0 or 1; {s.n_promo} rows are not")


def flag_invalid_rows(df: DataFrame) -> DataFrame:
    """Add ``errors``: the list of value rules a row breaks; sales and on_promo must be there."""
    rules = {
        "sales": ("sales must be >= 0", F.coalesce(F.col("sales") < 0, F.lit(True))),
        "on_promo": ("on_promo must be 0 or 1", _bad_flag("on_promo")),
        "price": ("price must be > 0", F.col("price") <= 0),
        "precipitation": ("precipitation must be >= 0", F.col("precipitation") < 0),
    }
    found = [F.when(bad, F.lit(text)) for c, (text, bad) in rules.items() if c in df.columns]
    return df.withColumn("errors", F.array_compact(F.array(*found)))


def validate_clean(df: DataFrame, strict: bool = False) -> None:
    """Keys present, date typed, promo flags 0/1. Null flags pass unless ``strict``; negative sales only warn."""
    require_columns(df, [DATE, *KEYS])
    if not isinstance(df.schema[DATE].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError("Date column is not a date")
    checks = []
    if "sales" in df.columns:
        checks.append(F.count_if(F.col("sales") < 0).alias("negative"))
    if "on_promo" in df.columns:
        checks.append(F.count_if(_bad_flag("on_promo", null_ok=not strict)).alias("promo"))
    if not checks:
        return
    found = df.agg(*checks).first().asDict()
    if found.get("negative"):
        log.warning("%d negative sales values", found["negative"])
    if found.get("promo"):
        raise ValueError(f"on_promo must be 0 or 1; {found['promo']} rows are not")


def feature_violations(df: DataFrame) -> DataFrame:
    """(check, column, n): nulls in the keys, infinities in the other columns that could hold them."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    inf = float("inf")
    counts = {("null", c): F.count_if(F.col(c).isNull()) for c in (*KEYS, DATE) if c in df.columns}
    counts |= {("infinite", c): F.count_if(F.col(c).isin(inf, -inf)) for c in floats}
    found = F.array(*[F.struct(F.lit(k).alias("check"), F.lit(c).alias("column"), n.alias("n")) for (k, c), n in counts.items()])
    return df.agg(found.alias("found")).select(F.inline("found"))


def validate_features(df: DataFrame, original: DataFrame) -> list[str]:
    """Raise if nothing was added or a key is null; return the numeric columns that hold infinities."""
    if len(df.columns) <= len(original.columns):
        raise ValueError("the feature table has no more columns than its input")
    found = [r for r in feature_violations(df).collect() if r.n]
    for r in found:
        if r.check == "null":
            raise ValueError(f"{r.column} is null in {r.n} rows")
    infinite = [r.column for r in found]
    if infinite:
        log.warning("infinite values in %s", infinite)
    return infinite


def validate_series(panel: Panel) -> bool:
    """True if the columns exist, keys are set and no (series, date) repeats."""
    need = [*panel.keys, panel.date, panel.target]
    if any(c not in panel.df.columns for c in need):
        return False
    key = [*panel.keys, panel.date]
    counted = panel.df.groupBy(*key).count()
    bad = counted.where((F.col("count") > 1) | F.array_contains(F.array(*[F.col(c).isNull() for c in key]), True))
    return bad.isEmpty()


def validate_forecast_requests(requests: DataFrame) -> DataFrame:
    """Add ``errors`` to a request table."""
    days = F.datediff("end_date", "start_date")
    found = [
        F.when(F.exists("promo_plan", lambda p: p.isNull() | ~p.isin(0, 1)), F.lit("promo_plan must contain only 0 and 1")),
        F.when(F.exists("price_plan", lambda p: p.isNull() | (p <= 0)), F.lit("price_plan must be positive")),
        F.when(F.coalesce(days <= 0, F.lit(True)), F.lit("end_date must be after start_date")),
        F.when(days > 365, F.lit("horizon must not exceed 365 days")),
    ]
    return requests.withColumn("errors", F.array_compact(F.array(*found)))


def validate_inventory_requests(requests: DataFrame) -> DataFrame:
    """Add ``errors`` to a request table; a missing value breaks its rule."""
    broken = lambda rule: F.coalesce(~rule, F.lit(True))
    found = [
        F.when(broken(F.col("service_level").between(0.5, 0.999)), F.lit("service_level must be in [0.5, 0.999]")),
        F.when(broken(F.col("lead_time").between(1, 365)), F.lit("lead_time must be in [1, 365]")),
        F.when(broken((F.col("holding_cost") >= 0) & (F.col("stockout_cost") >= 0)), F.lit("costs must be >= 0")),
    ]
    return requests.withColumn("errors", F.array_compact(F.array(*found)))


def chronology(train: DataFrame, val: DataFrame, date: str = DATE) -> DataFrame:
    """One row: the last day of training, the first of validation, and whether they overlap."""
    ends = train.sparkSession.range(1).select(train.agg(F.max(date)).scalar().alias("train_end"), val.agg(F.min(date)).scalar().alias("val_start"))
    return ends.withColumn("leaks", F.coalesce(F.col("train_end") >= F.col("val_start"), F.lit(False)))


def assert_chronological(train: DataFrame, val: DataFrame, date: str = DATE) -> None:
    found = chronology(train, val, date).first()
    if found.leaks:
        raise ValueError(f"Data leakage: training ends {found.train_end}, validation starts {found.val_start}")
