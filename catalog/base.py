"""Registry, output form and the SQL of the shared panels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.operators.clean import fill_calendar_gaps
from shelfcast.panel import Panel
from shelfcast.sources.star import event_panel, sales_panel

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

PANEL = """
panel AS (
  SELECT CAST(l_shipdate AS DATE) AS date, r_name AS store_id, l_returnflag AS item_id,
    sum(l_quantity) AS sales,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) >= 6 * count(*) AS INTEGER) AS on_promo,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) / sum(l_quantity) AS price,
    round(15 + 20 * sin(2 * pi() * (dayofyear(CAST(l_shipdate AS DATE)) - 80) / CAST(365.25 AS DOUBLE))
          + CAST(sum(l_linenumber) % 11 AS DOUBLE) - 5, 2) AS temperature,
    CAST(greatest((sum(l_linenumber) * 7) % 40 - 10, 0) AS DOUBLE) AS precipitation
  FROM lineitem
  JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey
  GROUP BY CAST(l_shipdate AS DATE), r_name, l_returnflag)"""

FILLED = (
    PANEL
    + """,
filled AS (
  SELECT d.date, k.store_id, k.item_id, p.sales, p.on_promo, p.price, p.temperature, p.precipitation
  FROM (SELECT DISTINCT store_id, item_id FROM panel) k
  CROSS JOIN (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM panel) d
  LEFT JOIN panel p ON p.date = d.date AND p.store_id = k.store_id AND p.item_id = k.item_id)"""
)

EVENTS = """
panel AS (
  SELECT CAST(ts AS DATE) AS date, 'all' AS store_id, event_type AS item_id, round(sum(value), 6) AS sales
  FROM events GROUP BY CAST(ts AS DATE), event_type)"""

K = "store_id, item_id"
W = "PARTITION BY store_id, item_id ORDER BY date"


def trailing(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def preceding(n: int) -> str:
    return f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


# Doubles are cut to a fixed number of digits by the same arithmetic on both sides. The offset is not
# one half, so that exact fractions such as 1/32 do not sit on the edge between two results.
OFFSET = 0.4371


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles cut to ``digits``, dates as text."""
    scale = float(10**digits)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.floor(c * scale + OFFSET) / scale
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def tidy_sql(sql: str, doubles: Sequence[str] = (), dates: Sequence[str] = (), digits: int = 6) -> str:
    scale = f"1e{digits}"
    fixes = [f'floor(CAST("{c}" AS DOUBLE) * {scale} + {OFFSET}) / {scale} + 0.0 AS "{c}"' for c in doubles]
    fixes += [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in dates]
    head, body = (sql.rsplit("--result", 1) + [None])[:2] if "--result" in sql else ("", sql)
    star = f"* REPLACE ({', '.join(fixes)})" if fixes else "*"
    return f"{head} SELECT {star} FROM ({body}) AS result_rows"


def query(name: str, sql: str | None = None, doubles: Sequence[str] = (), dates: Sequence[str] = (), digits: int = 6):
    """Register a query; with ``sql`` also the statement that must give the same rows.

    ``sql`` may start with common table expressions that end at a line ``--result``.
    """

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: tidy(fn(spark, folder), digits)
        if sql is not None:
            SQL[name] = tidy_sql(sql, doubles, dates, digits)
        return fn

    return add


def panel_of(spark, folder: str) -> DataFrame:
    return sales_panel(spark, folder)


def filled_of(spark, folder: str) -> DataFrame:
    return fill_calendar_gaps(sales_panel(spark, folder))


def events_of(spark, folder: str) -> DataFrame:
    return event_panel(spark, folder)


def as_panel(df: DataFrame) -> Panel:
    return Panel(df)
