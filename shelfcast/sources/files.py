"""Reading and writing panels as CSV, Parquet and JSON."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.panel import union_all

log = logging.getLogger(__name__)

RAW_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("store_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("sales", T.DoubleType()),
        T.StructField("on_promo", T.IntegerType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("precipitation", T.DoubleType()),
        T.StructField("holiday_name", T.StringType()),
    ]
)
# File suffixes and the format they stand for.
SUFFIXES = {"csv": "csv", "parquet": "parquet", "json": "json", "jsonl": "json"}


def format_of(path: str, fmt: str | None = None) -> str:
    kind = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind not in SUFFIXES:
        raise ValueError(f"files of the kind {kind} cannot be read or written")
    return SUFFIXES[kind]


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing value only: NaN becomes null in float columns."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}) if floats else df


def read_panel(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None,
               json_array: bool = False) -> DataFrame:
    """Read one file or folder. Without a schema, CSV columns come as strings and JSON is inferred.

    ``json_array`` reads files that hold one JSON array each; JSON lines are the default because
    they split over tasks.
    """
    kind = format_of(path, fmt)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        if kind == "csv":
            df = reader.option("header", True).csv(path)
        elif kind == "json":
            df = reader.option("multiLine", json_array).json(path)
        else:
            df = reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise
    return nan_to_null(df)


def write_panel(df: DataFrame, path: str, fmt: str | None = None, mode: str = "error",
                partition_by: Sequence[str] = ()) -> None:
    """Write a panel folder. JSON is written as lines."""
    kind = format_of(path, fmt)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def _csv_headers(spark: SparkSession, path: str, pattern: str) -> list[tuple[str, list[str]]]:
    lines = spark.read.option("pathGlobFilter", pattern).text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("i"),
    )
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "i").alias("header"))
    return [(r.header, r.files) for r in first.groupBy("header").agg(F.collect_list("file").alias("files")).collect()]


def read_directory(spark: SparkSession, path: str, pattern: str = "*.csv",
                   schema: T.StructType | str | None = None) -> DataFrame:
    """Union of all matching files of a folder by column name; unreadable files are left out.

    With a schema this is one scan. Without one, CSV files are grouped by their header line and
    read once per distinct header.
    """
    kind = format_of(pattern)
    try:
        reader = spark.read.option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True)
        if schema is not None:
            reader = reader.schema(schema)
        if kind == "parquet":
            return nan_to_null(reader.option("mergeSchema", schema is None).parquet(path))
        if kind == "json":
            return nan_to_null(reader.json(path))
        if schema is not None:
            return nan_to_null(reader.option("header", True).option("enforceSchema", False).csv(path))
        groups = _csv_headers(spark, path, pattern)
    except AnalysisException as e:
        raise ValueError(f"No readable files {pattern} in {path}") from e
    frames = []
    for header, files in groups:
        try:
            frames.append(spark.read.option("header", True).option("ignoreCorruptFiles", True).csv(files))
        except (AnalysisException, Py4JJavaError):
            log.warning("left out %d unreadable files with header %r", len(files), header)
    if not frames:
        raise ValueError(f"No readable files {pattern} in {path}")
    return nan_to_null(union_all(frames))


def load_data(spark: SparkSession, source: str = "local", **kwargs) -> DataFrame:
    if source != "local":
        raise ValueError(f"no data source of the name {source}")
    if "directory" in kwargs:
        return read_directory(spark, kwargs.pop("directory"), **kwargs)
    return read_panel(spark, kwargs.pop("path"), **kwargs)


def cast_panel(df: DataFrame, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Bring string columns to the panel types; what cannot be read becomes null."""
    known = {f.name: f.dataType for f in schema.fields}
    return df.select(*[F.col(c).try_cast(known[c]).alias(c) if c in known else F.col(c) for c in df.columns])


def write_importance(importance: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Feature importance, largest first, as CSV. One row per feature, so one file."""
    importance.orderBy(F.desc("importance"), "feature").coalesce(1).write.mode(mode).option("header", True).csv(path)
