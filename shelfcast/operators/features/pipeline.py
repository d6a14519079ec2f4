"""All feature families together, and the fitted leakage-safe pipeline."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.config import DATE, KEYS, Config
from shelfcast.functions.ranking import checkpointed, rank_within
from shelfcast.functions.series import add_ema, add_levels, series_window
from shelfcast.operators.features import price_promo, weather
from shelfcast.operators.features.calendar import add_calendar
from shelfcast.operators.features.holiday import add_holidays
from shelfcast.operators.features.lag import SAFE_ALPHA, lag_level, promo_level, safe_columns
from shelfcast.operators.validate import validate_features

log = logging.getLogger(__name__)


def add_feature_flags(df: DataFrame, as_of=None) -> DataFrame:
    """Mark the table as featurised; the count takes in the first two marks."""
    n = len(df.columns) + 2
    return df.withColumns({
        "feature_engineered": F.lit(True),
        "feature_engineering_date": F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp(),
        "feature_count": F.lit(n),
    })


def _finish(out: DataFrame, df: DataFrame, families: list, config: Config, target: str, keys, date, holidays) -> DataFrame:
    if config.include_price_promo:
        families.append(price_promo.levels(df.columns, sales=target, keys=keys, date=date))
    elif config.include_lags and "on_promo" in df.columns:
        families.append(promo_level("on_promo", keys, date, config.rolling_windows))
    if config.include_weather:
        families.append(weather.levels(df.columns, keys=keys, date=date))
    out = add_levels(out, *families)
    if config.include_price_promo and "on_promo" in df.columns:
        out = price_promo.run_lengths(out)
    if config.include_calendar:
        out = add_holidays(add_calendar(out, date), holidays, date)
    return out


def build_features(df: DataFrame, config: Config = Config(), target: str = "sales", keys: Sequence[str] = KEYS,
                   date: str = DATE, holidays: DataFrame | None = None, as_of=None, check: bool = False) -> DataFrame:
    """Calendar, lags, price and promotion, and (if switched on) weather, over one shuffle on the keys.

    Steps that sort again come first, while rows are narrow; calendar columns come last.
    """
    w = series_window(keys, date)
    families, out = [], df
    if config.include_lags:
        out = add_ema(out, target, f"{target}_ema_{int(1 / config.ema_alpha)}", config.ema_alpha, adjust=False, keys=keys, date=date)
        families.append((lag_level(target, w, config.rolling_windows, config.max_lag), {}, []))
    out = _finish(out, df, families, config, target, keys, date, holidays)
    out = add_feature_flags(out, as_of)
    if check:
        validate_features(out, df)
    return out


# --- label encoding -------------------------------------------------------------------------


def fit_labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Dictionary rows (column, value, code): the sorted distinct values of each column, from 0."""
    values = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    distinct = values.where("value is not null").distinct()
    return rank_within(distinct, ["column"], ["value"], "code").withColumn("code", F.col("code").cast("int"))


def encode_labels(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace values by their codes; unknown and missing values get code 0. Spark chooses the join by the dictionary's size."""
    order = df.columns
    for c in columns:
        part = dictionary.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
        df = df.join(part, F.col(c).cast("string") == F.col("_v"), "left")
        df = df.withColumn(c, F.coalesce("_code", F.lit(0))).drop("_v", "_code")
    return df.select(*order)


class FeaturePipeline:
    """Leakage-safe features with label dictionaries fitted on the training rows."""

    def __init__(self, config: Config = Config(), target: str = "sales", keys: Sequence[str] = KEYS, date: str = DATE,
                 holidays: DataFrame | None = None):
        self.config, self.target, self.keys, self.date, self.holidays = config, target, tuple(keys), date, holidays
        self.columns: list[str] | None = None
        self.encoded: list[str] = []
        self.dictionary: DataFrame | None = None

    @property
    def is_fitted(self) -> bool:
        return self.columns is not None

    def _build(self, df: DataFrame) -> DataFrame:
        missing = [c for c in (*self.keys, self.date) if c not in df.columns]
        if missing:
            raise ValueError(f"features per series need the columns {missing}")
        families, out = [], df
        if self.config.include_lags:
            out = add_ema(out, self.target, f"{self.target}_ema_14", SAFE_ALPHA, adjust=True, keys=self.keys, date=self.date, shift=1)
            families.append((safe_columns(df.columns, self.target, series_window(self.keys, self.date)), {}, []))
        out = _finish(out, df, families, self.config, self.target, self.keys, self.date, self.holidays)
        return add_feature_flags(out)

    def fit(self, df: DataFrame) -> FeaturePipeline:
        built = self._build(df)
        new = [c for c in built.columns if c not in df.columns]
        self.encoded = [c for c in new if isinstance(built.schema[c].dataType, T.StringType)]
        self.dictionary = checkpointed(fit_labels(built, self.encoded)) if self.encoded else None
        self.columns = new
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.is_fitted:
            raise ValueError("call fit before transform")
        built = self._build(df)
        return encode_labels(built, self.dictionary, self.encoded) if self.encoded else built

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def feature_columns(self) -> list[str]:
        return list(self.columns or [])
