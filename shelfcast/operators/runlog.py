"""Run log and model table kept as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_SCHEMA = "run_id string, model string, fold int, metric string, value double, logged_at timestamp"
MODEL_SCHEMA = "name string, version int, stage string, path string, run_id string, changed_at timestamp"


def log_runs(rows: DataFrame, path: str) -> None:
    rows.select(*[c.split()[0] for c in RUN_SCHEMA.split(", ")]).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def best_runs(runs: DataFrame, metric: str = "sMAPE", ascending: bool = True, limit: int = 10) -> DataFrame:
    """Runs with the metric set, best first."""
    order = F.asc("value") if ascending else F.desc("value")
    return runs.where((F.col("metric") == metric) & F.col("value").isNotNull()).orderBy(order, "run_id").limit(limit)


def log_models(rows: DataFrame, path: str) -> None:
    rows.select(*[c.split()[0] for c in MODEL_SCHEMA.split(", ")]).write.mode("append").parquet(path)


def current_stages(models: DataFrame) -> DataFrame:
    """The newest row of each (name, version): later rows overrule earlier stages."""
    w = Window.partitionBy("name", "version").orderBy(F.desc("changed_at"), F.desc("stage"), F.desc("path"), F.desc("run_id"))
    return models.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def list_models(models: DataFrame, name: str | None = None) -> DataFrame:
    out = current_stages(models)
    return out.where(F.col("name") == name) if name else out


def latest_model(models: DataFrame, name: str | None = None, stage: str | None = None) -> DataFrame:
    """Highest version per (name, stage)."""
    out = list_models(models, name)
    if stage:
        out = out.where(F.col("stage") == stage)
    w = Window.partitionBy("name", "stage").orderBy(F.desc("version"))
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def promote(models: DataFrame, name: str, version: int, stage: str, changed_at) -> DataFrame:
    """The row to append for a stage change."""
    row = current_stages(models).where((F.col("name") == name) & (F.col("version") == version))
    return row.withColumns({"stage": F.lit(stage), "changed_at": F.lit(changed_at).cast("timestamp")})


def champion_row(models: DataFrame, runs: DataFrame, name: str, stage: str = "Production"):
    """Model row in the stage, else that of the run with the smallest sMAPE; None without either."""
    row = latest_model(models, name, stage).orderBy(F.desc("version")).first()
    if row is not None:
        return row
    named = list_models(models, name)
    runs = runs.join(named.select("run_id"), "run_id", "left_semi")
    best = best_runs(runs, "sMAPE", limit=1).first()
    return None if best is None else named.where(F.col("run_id") == best.run_id).orderBy(F.desc("version")).first()


def load_champion(models: DataFrame, runs: DataFrame, name: str, stage: str = "Production"):
    """The fitted model, with ``predict``."""
    from shelfcast.operators.models import load_fitted

    row = champion_row(models, runs, name, stage)
    if row is None:
        raise ValueError(f"no model named {name}")
    return load_fitted(models.sparkSession, row.path)
