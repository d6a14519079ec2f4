"""Daily sales panels out of order-line tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_store(lines: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Add ``store_id``, the region of the supplier.

    Lines meet the plain supplier table first, so the planner sees its true size: it is broadcast
    when small and shuffled, with skew splitting, when not. Nation and region are fixed reference
    lists of 25 and 5 rows.
    """
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("store_id"))
    return (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    )


def sales_panel(spark: SparkSession, folder: str, item: str = "l_returnflag") -> DataFrame:
    """One row per (date, region, item) with sales, promo flag, price and weather stand-ins.

    Flags and cents are summed as integers, so results do not depend on summation order. Only
    daily totals leave the map side, so a busy store or item costs no more than a quiet one.
    """
    lines = table(spark, folder, "lineitem")
    if item != "l_returnflag":
        part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), item)
        lines = lines.join(part, "l_partkey")
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    discount = F.floor(F.col("l_discount") * 100 + 0.5)
    daily = (
        with_store(lines, spark, folder)
        .groupBy(F.col("l_shipdate").cast("date").alias("date"), "store_id", F.col(item).alias("item_id"))
        .agg(
            F.sum("l_quantity").alias("sales"),
            F.sum(discount).alias("discount"),
            F.sum(cents).alias("cents"),
            F.sum("l_linenumber").alias("numbers"),
            F.count("*").alias("n"),
        )
    )
    season = F.sin(2 * F.pi() * (F.dayofyear("date") - 80) / 365.25)
    return daily.select(
        "date",
        "store_id",
        "item_id",
        "sales",
        (F.col("discount") >= 6 * F.col("n")).cast("int").alias("on_promo"),
        F.try_divide(F.col("cents") / F.lit(100.0), F.col("sales")).alias("price"),
        F.round(15 + 20 * season + F.col("numbers") % 11 - 5, 2).alias("temperature"),
        F.greatest((F.col("numbers") * 7) % 40 - 10, F.lit(0)).cast("double").alias("precipitation"),
    )


def event_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Daily totals of events per type, as a second panel."""
    ev = table(spark, folder, "events")
    return ev.groupBy(F.col("ts").cast("date").alias("date"), F.lit("all").alias("store_id"),
                      F.col("event_type").alias("item_id")).agg(F.round(F.sum("value"), 6).alias("sales"))
