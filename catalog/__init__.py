"""The queries this library answers on the given tables, each beside its SQL."""

from catalog import checks, data_quality, features, flagship, forecasting, learning, operations, storage  # noqa: F401
from catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
