"""Readers, writers and the run log, as round trips through a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import PANEL, SQL, panel_of, query
from catalog.forecasting import runs_of
from shelfcast.functions.ranking import shared_folder
from shelfcast.operators import profile, runlog
from shelfcast.sources import files

WHOLE = f"WITH {PANEL} --result\nSELECT * FROM panel"
DOUBLES = ["sales", "price", "temperature", "precipitation"]


def fresh_folder(spark) -> str:
    """A new name in the folder that all executors share."""
    return f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"


def round_trip(spark, folder, kind: str):
    panel, path = panel_of(spark, folder), fresh_folder(spark)
    files.write_panel(panel, path, fmt=kind)
    return files.read_panel(spark, path, fmt=kind, schema=panel.schema)


for _kind in ("csv", "json", "parquet"):

    @query(f"{_kind}_round_trip", WHOLE, DOUBLES, ["date"])
    def _(spark, folder, kind=_kind):
        return round_trip(spark, folder, kind)


@query("csv_directory", WHOLE, DOUBLES, ["date"])
def _(spark, folder):
    """Two folders of files with different headers, read as one table of text columns and cast."""
    panel, path = panel_of(spark, folder), fresh_folder(spark)
    files.write_panel(panel.where("price < 2000"), path, fmt="csv")
    rest = panel.where("not coalesce(price < 2000, false)")
    files.write_panel(rest.select(*reversed(rest.columns)), path, fmt="csv", mode="append")
    return files.cast_panel(files.read_directory(spark, path, "*.csv")).select(*panel.columns)


@query("profile_round_trip", SQL["completeness"])
def _(spark, folder):
    table, path = profile.series_completeness(panel_of(spark, folder)), fresh_folder(spark)
    profile.write_profile({"completeness": table}, path)
    return spark.read.schema(table.schema).json(f"{path}/completeness")


@query("importance_round_trip", f"WITH {PANEL} --result\n" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(abs({c})) AS importance FROM panel" for c in DOUBLES), ["importance"])
def _(spark, folder):
    path = fresh_folder(spark)
    means = panel_of(spark, folder).agg(*[F.avg(F.abs(c)).alias(c) for c in DOUBLES])
    files.write_importance(means.unpivot([], DOUBLES, "feature", "importance"), path)
    return spark.read.option("header", True).schema("feature string, importance double").csv(path)


@query("run_log", SQL["best_runs"])
def _(spark, folder):
    path = fresh_folder(spark)
    runlog.log_runs(runs_of(spark, folder), path)
    return runlog.best_runs(runlog.read_runs(spark, path), limit=10).drop("logged_at")
