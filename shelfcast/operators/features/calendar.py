"""Calendar features: scalar expressions of the date."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import DATE

# Special days as (month, first day, last day).
SPECIAL_DAYS = {
    "is_new_year": (1, 1, 1),
    "is_valentine": (2, 14, 14),
    "is_easter_period": (4, 10, 20),
    "is_mothers_day_period": (5, 8, 14),
    "is_fathers_day_period": (6, 15, 21),
    "is_independence_day": (7, 4, 4),
    "is_halloween": (10, 31, 31),
    "is_thanksgiving_period": (11, 22, 28),
    "is_black_friday_period": (11, 23, 29),
    "is_christmas_eve": (12, 24, 24),
    "is_christmas": (12, 25, 25),
    "is_new_year_eve": (12, 31, 31),
    "is_holiday_season": (12, 1, 31),
}
# Months of each season.
SEASONS = {"is_spring": (3, 4, 5), "is_summer": (6, 7, 8), "is_fall": (9, 10, 11), "is_winter": (12, 1, 2)}


def date_parts(date: str = DATE) -> dict[str, Column]:
    d = F.col(date).cast("date")
    dow = F.weekday(d)
    quarter_end = F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    return {
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(d),
        "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d),
        "week_of_month": (F.floor((F.dayofmonth(d) - 1) / 7) + 1).cast("int"),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "year": F.year(d),
        "is_month_start": F.dayofmonth(d) == 1,
        "is_month_end": d == F.last_day(d),
        "is_quarter_start": d == F.trunc(d, "quarter"),
        "is_quarter_end": d == quarter_end,
        "is_year_start": (F.month(d) == 1) & (F.dayofmonth(d) == 1),
        "is_year_end": (F.month(d) == 12) & (F.dayofmonth(d) == 31),
        "is_weekend": dow.isin(5, 6),
        "is_working_day": dow.isin(0, 1, 2, 3, 4),
    }


def special_days(date: str = DATE) -> dict[str, Column]:
    m, d = F.month(date), F.dayofmonth(date)
    return {n: (m == month) & d.between(a, b) for n, (month, a, b) in SPECIAL_DAYS.items()}


def seasons(date: str = DATE) -> dict[str, Column]:
    return {n: F.month(date).isin(*months) for n, months in SEASONS.items()}


def cyclical(date: str = DATE) -> dict[str, Column]:
    """Sine and cosine of the position in the year, month cycle, week and day."""
    turns = {
        "annual": F.dayofyear(date) / 365.25,
        "monthly": F.month(date) / 12.0,
        "weekly": F.weekday(date) / 7.0,
        "daily": F.hour(F.col(date).cast("timestamp")) / 24.0,
    }
    out = {}
    for n, t in turns.items():
        out[f"{n}_sin"] = F.sin(2 * math.pi * t)
        out[f"{n}_cos"] = F.cos(2 * math.pi * t)
    return out


def fourier(t: Column, period: float, order: int, name: str) -> dict[str, Column]:
    """Sine and cosine terms up to ``order`` of a day number with the given period."""
    out = {}
    for k in range(1, order + 1):
        out[f"{name}_sin_{k}"] = F.sin(2 * math.pi * k / period * t)
        out[f"{name}_cos_{k}"] = F.cos(2 * math.pi * k / period * t)
    return out


def calendar_columns(date: str = DATE) -> dict[str, Column]:
    return {**date_parts(date), **special_days(date), **seasons(date), **cyclical(date)}


def add_calendar(df: DataFrame, date: str = DATE) -> DataFrame:
    return df.withColumns(calendar_columns(date))
