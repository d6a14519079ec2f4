"""The panel: daily rows per series, and selections over it.

A panel holds at most one row per (series, date). ``clean.drop_duplicates`` makes it so and
``validate.validate_series`` checks it. That is what bounds every per-series window in this
library: a window partition is never longer than the calendar span in days, however the raw
rows were spread over the series.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.config import DATE, KEYS, TARGET


@dataclass(frozen=True)
class Panel:
    df: DataFrame
    target: str = TARGET
    keys: tuple[str, ...] = KEYS
    date: str = DATE

    def with_df(self, df: DataFrame) -> Panel:
        return replace(self, df=df)


def split_by_date(panel: Panel, train_end, val_start=None, test_start=None) -> tuple[Panel, Panel | None, Panel | None]:
    """Train is ``<= train_end``; validation is ``[val_start, test_start)``; test is ``>= test_start``.

    Without ``test_start`` the validation part ends before the last date of the panel.
    """
    d = F.col(panel.date)
    train = panel.with_df(panel.df.where(d <= F.lit(train_end)))
    val = test = None
    if val_start is not None:
        upper = F.lit(test_start) if test_start is not None else panel.df.agg(F.max(d)).scalar()
        val = panel.with_df(panel.df.where((d >= F.lit(val_start)) & (d < upper)))
    if test_start is not None:
        test = panel.with_df(panel.df.where(d >= F.lit(test_start)))
    return train, val, test


def filter_series(panel: Panel, series: DataFrame | Iterable[Sequence]) -> Panel:
    """Keep the listed series. ``series`` is a key frame, or a short list of key tuples."""
    if not isinstance(series, DataFrame):
        schema = T.StructType([panel.df.schema[k] for k in panel.keys])
        series = panel.df.sparkSession.createDataFrame([tuple(s) for s in series], schema)
    return panel.with_df(panel.df.join(series.select(*panel.keys), list(panel.keys), "left_semi"))


def split_by_series(panel: Panel, train, val, test) -> tuple[Panel, Panel, Panel]:
    return filter_series(panel, train), filter_series(panel, val), filter_series(panel, test)


def recent(df: DataFrame, days: int = 7, date: str = DATE) -> DataFrame:
    """Rows dated within ``days`` of the newest row."""
    last = df.agg(F.max(date)).scalar()
    return df.where(F.col(date) >= F.date_sub(last, days))


def rolling_origin_splits(panel: Panel, n_splits: int = 5, test_size: int = 28, gap: int = 0) -> list[dict]:
    """Expanding windows by date: train up to ``train_end``, validate on ``[val_start, val_end]``."""
    first, last = panel.df.agg(F.min(panel.date), F.max(panel.date)).first()
    if first is None:
        raise ValueError("cannot split an empty panel")
    span = (last - first).days + 1
    if n_splits * test_size + gap >= span:
        raise ValueError(f"{n_splits} splits of {test_size} days do not fit into {span} days")
    out = []
    for i in range(n_splits):
        val_start = last - dt.timedelta(days=(n_splits - i) * test_size - 1)
        out.append(
            {
                "fold": i + 1,
                "train_end": val_start - dt.timedelta(days=1 + gap),
                "val_start": val_start,
                "val_end": val_start + dt.timedelta(days=test_size - 1),
            }
        )
    return out


def split_at(panel: Panel, fold: dict) -> tuple[DataFrame, DataFrame]:
    d = F.col(panel.date)
    return (
        panel.df.where(d <= F.lit(fold["train_end"])),
        panel.df.where(d.between(F.lit(fold["val_start"]), F.lit(fold["val_end"]))),
    )


def feature_columns(df: DataFrame, exclude: Iterable[str] = (), panel: Panel | None = None) -> list[str]:
    """Columns usable as model input: numeric, boolean or string, without target, date and keys."""
    own = {panel.target, panel.date, *panel.keys} if panel else {TARGET, DATE, *KEYS}
    skip = own | set(exclude)
    kinds = (T.NumericType, T.BooleanType, T.StringType)
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, kinds)]


def series_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.select(*keys).distinct()


def series_count(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return series_keys(df, keys).agg(F.count("*").alias("n_series"))


def date_range(df: DataFrame, date: str = DATE) -> DataFrame:
    return df.agg(F.min(date).alias("start"), F.max(date).alias("end"))


def series_info(panel: Panel) -> DataFrame:
    t = F.col(panel.target)
    return panel.df.groupBy(*panel.keys).agg(
        F.min(panel.date).alias("start"),
        F.max(panel.date).alias("end"),
        F.count("*").alias("length"),
        F.count_if(t.isNull()).alias("n_missing"),
        F.avg(t).alias("mean"),
        F.stddev_samp(t).alias("std"),
        F.min(t).alias("min"),
        F.max(t).alias("max"),
    ).withColumn("series", F.concat_ws("_", *panel.keys))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("nothing to union")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def top_k(df: DataFrame, order: Sequence, k: int, by: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows in the given order, overall or per group."""
    if not by:
        return df.orderBy(*order).limit(k)
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")
