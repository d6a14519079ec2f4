"""Data profiles as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.config import DATE, KEYS
from shelfcast.functions.series import series_window
from shelfcast.operators.quantiles import exact_quantiles
from shelfcast.panel import union_all

# Fixed value: a value further than this many standard deviations from the mean is an outlier.
Z_LIMIT = 3


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _long(row: DataFrame, name: str = "metric") -> DataFrame:
    """A one-row frame as (metric, value) rows, values as doubles."""
    cast = row.select(*[F.col(c).cast("double").alias(c) for c in row.columns])
    return cast.unpivot([], cast.columns, name, "value")


def data_summary(df: DataFrame) -> DataFrame:
    """One row: size, period, distinct counts, sales statistics, promotion share."""
    median = exact_quantiles(df, ["sales"], [0.5])["sales"]
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.min(DATE).alias("start"),
        F.max(DATE).alias("end"),
        F.datediff(F.max(DATE), F.min(DATE)).alias("days"),
        F.countDistinct("store_id").alias("n_stores"),
        F.countDistinct("item_id").alias("n_items"),
        F.sum("sales").alias("sales_total"),
        F.avg("sales").alias("sales_mean"),
        F.lit(median[0] if median else None).cast("double").alias("sales_median"),
        F.stddev_samp("sales").alias("sales_std"),
        F.min("sales").alias("sales_min"),
        F.max("sales").alias("sales_max"),
        F.sum("on_promo").alias("promo_days"),
        (F.avg("on_promo") * 100).alias("promo_pct"),
    )


def first_ids(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.select(column).distinct().orderBy(column).limit(n)


def nulls_per_column(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.unpivot([], row.columns, "column", "n_null")


def table_info(df: DataFrame) -> DataFrame:
    """Per column: type and nulls, with the row count and the number of exact copies beside them."""
    copies = df.groupBy(*df.columns).count().agg(F.sum(F.col("count") - 1).alias("n")).scalar()
    rows = df.agg(F.count("*").alias("n")).scalar()
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kind = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return nulls_per_column(df).select("column", kind[F.col("column")].alias("type"), "n_null",
                                       rows.alias("n_rows"), F.coalesce(copies, F.lit(0)).alias("n_copies"))


def fingerprint(df: DataFrame, run_id: str) -> DataFrame:
    """Shape and nulls per column as run-log rows (param name, value)."""
    info = table_info(df)
    rows = info.select(F.concat(F.lit("nulls."), "column").alias("name"), F.col("n_null").cast("string").alias("value"))
    head = info.limit(1).select(F.lit("rows").alias("name"), F.col("n_rows").cast("string").alias("value"))
    cols = info.agg(F.lit("columns").alias("name"), F.count("*").cast("string").alias("value"))
    return rows.unionByName(head).unionByName(cols).select(F.lit(run_id).alias("run_id"), "name", "value")


def column_cardinality(df: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct non-null values per column.

    Values are made unique per column with partial aggregation before they are counted, so there
    is one shuffle of distinct values and no column is gathered. ``exact=False`` uses sketches.
    """
    if not exact:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in df.columns])
        return row.unpivot([], row.columns, "column", "n_distinct")
    values = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "v")
    distinct = values.where("v is not null").distinct().groupBy("column").agg(F.count("*").alias("n_distinct"))
    every = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    return every.join(distinct, "column", "left").fillna(0, ["n_distinct"])


def missingness(df: DataFrame) -> DataFrame:
    """Nulls and percent per column, and over all cells under the name ``*``."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    per = row.unpivot(["n"], df.columns, "column", "n_null")
    total = per.agg(F.lit("*").alias("column"), F.sum("n_null").alias("n_null"), F.sum("n").alias("n"))
    return per.select("column", "n_null", "n").unionByName(total).select(
        "column", "n_null", (F.try_divide("n_null", "n") * 100).alias("pct_null")
    )


def missing_runs(df: DataFrame, column: str = "sales", keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    """Per series: number, longest and mean length of runs of consecutive missing values in date order."""
    w = series_window(keys, date).rowsBetween(Window.unboundedPreceding, 0)
    missing = F.col(column).isNull()
    runs = (
        df.select(*keys, missing.alias("_m"), F.count(column).over(w).alias("_run"))
        .where("_m")
        .groupBy(*keys, "_run")
        .agg(F.count("*").alias("len"))
    )
    return runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.sum("len").alias("n_missing"),
                                   F.max("len").alias("max_run"), F.avg("len").alias("avg_run"))


def duplicate_stats(df: DataFrame) -> DataFrame:
    """One row: exact copies, copies by (series, date) and rows beyond the first of each series."""
    # Each level sums up the one below, so this is one scan.
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    days = rows.groupBy(DATE, *KEYS).agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") - 1).alias("_rows"))
    series = days.groupBy(*KEYS).agg(F.sum("_n").alias("_n"), F.sum("_rows").alias("_rows"), F.sum(F.col("_n") - 1).alias("_days"))
    total = series.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("_n", "n_rows"), ("_rows", "exact_copies"), ("_days", "copies_by_key"))],
                       F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("copies_by_series"))
    share = (F.try_divide("exact_copies", "n_rows") * 100).alias("exact_copies_pct")
    return total.select("n_rows", "exact_copies", share, "copies_by_key", "copies_by_series")


def outlier_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: fences and z-score outliers with the basic statistics.

    First pass: quantiles and moments. Second pass: conditional counts against those as literals.
    """
    columns = list(columns or numeric_columns(df))
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    columns = [c for c in columns if q[c]]
    moments = df.agg(
        *[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns)
          for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    ).first()
    counts, parts = [F.count("*").alias("n")], []
    for i, c in enumerate(columns):
        lo = q[c][0] - 1.5 * (q[c][2] - q[c][0])
        hi = q[c][2] + 1.5 * (q[c][2] - q[c][0])
        mean, std = moments[f"mean_{i}"], moments[f"std_{i}"]
        counts.append(F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"iqr_{i}"))
        far = F.abs(F.try_divide(F.col(c) - mean, F.lit(std))) > Z_LIMIT
        counts.append(F.count_if(far).alias(f"z_{i}"))
        parts.append(F.struct(
            F.lit(c).alias("column"), F.col(f"iqr_{i}").alias("iqr_count"), F.col(f"z_{i}").alias("z_count"),
            F.lit(lo).alias("lower"), F.lit(hi).alias("upper"), F.lit(mean).cast("double").alias("mean"),
            F.lit(q[c][1]).alias("median"), F.lit(std).cast("double").alias("std"),
            F.lit(moments[f"min_{i}"]).cast("double").alias("min"), F.lit(moments[f"max_{i}"]).cast("double").alias("max"),
        ))
    wide = df.agg(*counts).select("n", F.explode(F.array(*parts)).alias("s"))
    return wide.select("s.*", (F.try_divide("s.iqr_count", "n") * 100).alias("iqr_pct"),
                       (F.try_divide("s.z_count", "n") * 100).alias("z_pct"))


def missing_dates(df: DataFrame, date: str = DATE) -> DataFrame:
    """Days between the first and last date that no row has."""
    days = df.select(date).where(F.col(date).isNotNull()).distinct()
    span = df.agg(F.min(date).alias("a"), F.max(date).alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b")).alias(date))
    return every.join(days, date, "left_anti")


def missing_date_summary(df: DataFrame, date: str = DATE, first: int = 10) -> tuple[DataFrame, DataFrame]:
    """(count of missing days, the first few of them)."""
    gone = missing_dates(df, date)
    return gone.agg(F.count("*").alias("n_missing_dates")), gone.orderBy(date).limit(first)


def series_completeness(df: DataFrame, keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    """Rows against the calendar days of each series' own period. Days are made unique before counting."""
    per_day = df.groupBy(*keys, date).agg(F.count("*").alias("n"))
    span = F.datediff(F.max(date), F.min(date)) + 1
    return per_day.groupBy(*keys).agg(
        F.sum("n").alias("total_days"),
        (span - F.count(date)).alias("missing_days"),
        (F.sum("n") / span * 100).alias("completeness"),
    )


def value_histogram(df: DataFrame, column: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram between the smallest and largest value; the last bin holds the maximum, and empty bins have 0 rows."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        raise ValueError(f"{column} has no values")
    low, high = float(low), float(high)
    if low == high:
        low, high = low - 0.5, high + 0.5
    cell = F.least(F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins).cast("long"))
    step = (high - low) / bins
    found = df.where(F.col(column).isNotNull()).groupBy(*by, cell.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    groups = found.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = groups.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    counted = every.join(found, [*by, "bin"], "left").fillna(0, ["n"])
    return counted.select(*by, "bin", (F.lit(low) + (F.col("bin") - 1) * step).alias("lower"),
                          (F.lit(low) + F.col("bin") * step).alias("upper"), "n")


def daily_totals(df: DataFrame, column: str = "sales", date: str = DATE) -> DataFrame:
    return df.groupBy(date).agg(F.sum(column).alias(f"total_{column}"))


def overview_kpis(df: DataFrame, store: str | None = None, item: str | None = None) -> DataFrame:
    """Total and mean sales, promotion days and mean price, for one series or for each."""
    if store is not None:
        df = df.where(F.col("store_id") == store)
    if item is not None:
        df = df.where(F.col("item_id") == item)
    return df.groupBy(*KEYS).agg(
        F.sum("sales").alias("total_sales"), F.avg("sales").alias("mean_sales"),
        F.sum("on_promo").alias("promo_days"), F.avg("price").alias("mean_price"),
    )


def quality_report(df: DataFrame) -> dict[str, DataFrame]:
    """All profile tables by name."""
    return {
        "cardinality": column_cardinality(df),
        "missingness": missingness(df),
        "missing_runs": missing_runs(df),
        "duplicates": duplicate_stats(df),
        "outliers": outlier_stats(df),
        "missing_dates": missing_dates(df),
        "completeness": series_completeness(df),
    }


def report_table(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables of a report as (section, item, metric, value): numbers as doubles, beside the texts that name their row.

    A table without numbers gives its rows the metric ``n`` of 1.
    """
    out = []
    for section, t in tables.items():
        numbers = numeric_columns(t)
        item = F.concat_ws("/", F.lit(None).cast("string"), *[F.col(c).cast("string") for c in t.columns if c not in numbers])
        values = [F.col(c).cast("double").alias(c) for c in numbers] or [F.lit(1.0).alias("n")]
        long = t.select(item.alias("item"), *values).unpivot(["item"], numbers or ["n"], "metric", "value")
        out.append(long.select(F.lit(section).alias("section"), "*"))
    return union_all(out)


def write_profile(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    for name, t in tables.items():
        t.write.mode(mode).json(f"{path}/{name}")
