"""Per-series window expressions shared by the feature families."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.config import DATE, KEYS

START = Window.unboundedPreceding


def series_window(keys: Sequence[str] = KEYS, date: str = DATE):
    return Window.partitionBy(*keys).orderBy(date)


def newest_first(keys: Sequence[str] = KEYS, date: str = DATE):
    return Window.partitionBy(*keys).orderBy(F.desc(date))


def trailing(w, n: int):
    """The last ``n`` rows, this one included."""
    return w.rowsBetween(-(n - 1), 0)


def preceding(w, n: int):
    """The ``n`` rows before this one."""
    return w.rowsBetween(-n, -1)


def change_base(x: Column, w, prefix: str) -> dict[str, Column]:
    """First-level columns for a relative change: the last known value up to this row and before it."""
    return {
        f"{prefix}_now": F.last(x, ignorenulls=True).over(w.rowsBetween(START, 0)),
        f"{prefix}_before": F.last(x, ignorenulls=True).over(w.rowsBetween(START, -1)),
    }


def pct_change(prefix: str) -> Column:
    """Relative change of the forward-filled value; null where there is no base or it is zero."""
    return F.try_divide(F.col(f"{prefix}_now"), F.col(f"{prefix}_before")) - 1


def slope(x: Column, pos: Column, w, n: int) -> Column:
    """Least-squares slope over the last ``n`` rows; 0.0 with one row or a missing value among them."""
    frame = trailing(w, n)
    valid, rows = F.count(x).over(frame), F.count(F.lit(1)).over(frame)
    fit = F.regr_slope(x, pos.cast("double")).over(frame)
    return F.when(valid == 0, F.lit(None)).when((rows < 2) | (valid < rows), F.lit(0.0)).otherwise(fit)


def fill_forward(x: Column, w) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(START, 0))


def fill_backward(x: Column, newest_first) -> Column:
    """Takes a window in descending order: frames that run to the end of the partition cost
    quadratic time, frames that start at its beginning do not."""
    return F.last(x, ignorenulls=True).over(newest_first.rowsBetween(START, 0))


def run_marks(x: Column, w, prefix: str) -> dict[str, Column]:
    """First-level columns for run positions: row number, run start, run end. A null is its own run."""
    same_before = F.coalesce(x == F.lag(x).over(w), F.lit(False))
    same_after = F.coalesce(x == F.lead(x).over(w), F.lit(False))
    return {
        f"{prefix}_rn": F.row_number().over(w),
        f"{prefix}_starts": ~same_before,
        f"{prefix}_ends": ~same_after,
    }


def run_since(w, prefix: str) -> Column:
    """0-based position inside the current run of equal values."""
    rn = F.col(f"{prefix}_rn")
    start = F.last(F.when(F.col(f"{prefix}_starts"), rn), ignorenulls=True).over(w.rowsBetween(START, 0))
    return (rn - start).cast("int")


def run_until(newest_first, prefix: str) -> Column:
    """0-based distance to the end of the current run."""
    rn = F.col(f"{prefix}_rn")
    end = fill_backward(F.when(F.col(f"{prefix}_ends"), rn), newest_first)
    return (end - rn).cast("int")


def add_levels(df: DataFrame, *families: tuple[dict, dict, list]) -> DataFrame:
    """Add the columns of several families in two steps.

    A family is (windows over the table, expressions and windows over those, columns to drop). All
    share one partitioning and order, so each step is one pass over the sorted rows.
    """
    one, two, scratch = {}, {}, []
    for a, b, c in families:
        one.update(a)
        two.update(b)
        scratch += c
    if one:
        df = df.withColumns(one)
    if two:
        df = df.withColumns(two)
    return df.drop(*scratch)


def linear_recurrence(df: DataFrame, keys: Sequence[str], order: str, pos: Column, decay: Column | float,
                      inputs: Mapping[str, Column], max_decay: float) -> DataFrame:
    """Add columns ``s`` with ``s[i] = decay[i] * s[i-1] + input[i]`` per series; ``pos`` counts rows from 1.

    ``max_decay < 1`` bounds the decay per row over long stretches. The sum is taken inside blocks
    of rows with running-sum windows, rescaled so that nothing over- or underflows; the carry into
    a block is built from the few earlier blocks that still weigh anything in double precision.
    So each row costs O(1), with no arrays and no Python.
    """
    rows = max(8, int(math.log(1e-8) / math.log(max_decay)))
    blocks = math.ceil(math.log(1e-20) / (rows * math.log(max_decay)))
    w = Window.partitionBy(*keys).orderBy(order)
    inner = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(START, 0)
    df = df.withColumns({"_block": F.floor((pos - 1) / rows), "_at": (pos - 1) % rows})
    if isinstance(decay, float):
        df = df.withColumn("_a", F.pow(F.lit(decay), (F.col("_at") + 1).cast("double")))
    else:
        df = df.withColumn("_a", F.exp(F.sum(F.ln(decay)).over(inner)))
    df = df.withColumns({f"_s_{n}": F.col("_a") * F.sum(c / F.col("_a")).over(inner) for n, c in inputs.items()})
    back = range(1, blocks + 1)
    df = df.withColumns({f"_{c}_{k}": F.coalesce(F.lag(f"_{c}", k * rows).over(w), F.lit(0.0))
                         for c in ("a", *(f"s_{n}" for n in inputs)) for k in back})
    out = {}
    for n in inputs:
        total, weight = F.col(f"_s_{n}"), F.col("_a")
        for k in back:
            total = total + weight * F.col(f"_s_{n}_{k}")
            weight = weight * F.col(f"_a_{k}")
        ended = F.last(F.when(F.col("_at") == rows - 1, total), ignorenulls=True).over(w.rowsBetween(START, -1))
        out[n] = F.col(f"_s_{n}") + F.col("_a") * F.coalesce(ended, F.lit(0.0))
    scratch = ["_block", "_at", "_a", *(f"_a_{k}" for k in back), *(f"_s_{n}" for n in inputs),
               *(f"_s_{n}_{k}" for n in inputs for k in back)]
    return df.withColumns(out).drop(*scratch)


def add_ema(df: DataFrame, value: str, out: str, alpha: float, adjust: bool, keys: Sequence[str] = KEYS,
            date: str = DATE, shift: int = 0) -> DataFrame:
    """Exponentially weighted mean per series; weights decay by position, nulls carry the level on.

    ``adjust=False`` is the recursive form started at the first value, ``adjust=True`` the
    normalised weighted mean. ``shift`` moves the result to later rows (leakage-safe use).
    """
    w = series_window(keys, date)
    keep = 1.0 - alpha
    has = F.col(value).isNotNull()
    x = F.when(has, F.col(value).cast("double")).otherwise(0.0)
    pos = F.col("_pos")
    df = df.withColumn("_pos", F.row_number().over(w))
    if adjust:
        inputs = {"_num": x, "_den": F.when(has, F.lit(1.0)).otherwise(0.0)}
        df = linear_recurrence(df, keys, date, pos, keep, inputs, keep)
        level, scratch = F.try_divide(F.col("_num"), F.col("_den")), ["_num", "_den"]
    else:
        # After a gap of g rows the old level keeps the share keep^g / (keep^g + alpha). The gap
        # rows already decay by ``keep`` each, so the value row applies what is left of it.
        seen = F.last(F.when(has, pos), ignorenulls=True).over(w.rowsBetween(START, -1))
        df = df.withColumn("_old", F.pow(F.lit(keep), (pos - seen).cast("double")))
        old = F.col("_old")
        decay = F.when(has & old.isNotNull(), F.lit(keep) / (old + alpha)).otherwise(keep)
        gain = F.when(old.isNull(), F.lit(1.0)).otherwise(F.lit(alpha) / (old + alpha))
        slowest = max((keep**g / (keep**g + alpha)) ** (1 / g) for g in range(1, 400))
        df = linear_recurrence(df, keys, date, pos, decay, {"_num": x * gain}, slowest)
        level, scratch = F.col("_num"), ["_num", "_old"]
    frame = w.rowsBetween(START, -shift)
    return df.withColumn(out, F.last(F.when(has, level), ignorenulls=True).over(frame)).drop("_pos", *scratch)
