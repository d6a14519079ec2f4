"""Demand analytics on Spark: panel in, panel out."""

from shelfcast.config import Config
from shelfcast.panel import Panel

__all__ = ["Config", "Panel"]
