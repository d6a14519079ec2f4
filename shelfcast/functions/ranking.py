"""Ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    A local session without that setting, as in tests, uses its warehouse folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder, so that lost executors cost nothing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    kept = df.persist()
    try:
        return kept.checkpoint()
    finally:
        kept.unpersist()


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """0-based position of each row in its group under ``order``.

    Rows are sorted over range partitions, numbered inside each partition, and shifted by the rows before: one hot
    group may then span many tasks. Only one row per (partition, group) is summed up.
    """
    cols = [F.col(c) for c in (*by, *order)]
    numbered = checkpointed(df.orderBy(*cols).withColumn("_id", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_part", F.shiftright("_id", 33))
    # A group's rows are contiguous, so its first row in a partition is its smallest id there.
    starts = numbered.groupBy("_part", *by).agg(F.min("_id").alias("_start"), F.count("*").alias("_n"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_part")
    earlier = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.withColumn("_before", earlier).drop("_n")
    starts = starts.select(F.col("_part").alias("_sp"), "_start", "_before", *[F.col(c).alias(f"_s_{i}") for i, c in enumerate(by)])
    same = F.col("_part") == F.col("_sp")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{i}"))
    return numbered.join(starts, same).select(*df.columns, (F.col("_before") + F.col("_id") - F.col("_start")).alias(out))
