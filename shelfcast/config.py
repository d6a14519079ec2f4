"""Settings that change results."""

from __future__ import annotations

from dataclasses import dataclass

KEYS = ("store_id", "item_id")
DATE = "date"
TARGET = "sales"


@dataclass(frozen=True)
class Config:
    # The defaults a user of the library relies on.
    horizon: int = 28
    folds: int = 6
    metric: str = "RMSE"
    max_lag: int = 28
    rolling_windows: tuple[int, ...] = (7, 14, 28)
    ema_alpha: float = 0.3
    service_level: float = 0.95
    lead_time: int = 7
    holding_cost: float = 0.1
    stockout_cost: float = 10.0
    include_calendar: bool = True
    include_lags: bool = True
    include_price_promo: bool = True
    include_weather: bool = False
    seed: int = 42
