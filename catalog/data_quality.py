"""Panel building, validation, cleaning and profiling."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.base import EVENTS, FILLED, K, PANEL, W, as_panel, events_of, filled_of, panel_of, query
from shelfcast import panel as panels
from shelfcast.operators import clean, profile, validate
from shelfcast.operators.models import to_model_matrix
from shelfcast.sources import files
from shelfcast.sources.star import sales_panel, table

MEASURES = ["sales", "price", "temperature", "precipitation"]


@query("sales_panel", f"WITH {PANEL} --result\nSELECT * FROM panel", MEASURES, ["date"])
def _(spark, folder):
    return panel_of(spark, folder)


@query(
    "sales_panel_by_brand",
    f"""WITH {PANEL.replace("l_returnflag", "p_brand").replace("FROM lineitem", "FROM lineitem JOIN part ON p_partkey = l_partkey")}
--result
SELECT * FROM panel""",
    MEASURES,
    ["date"],
)
def _(spark, folder):
    return sales_panel(spark, folder, item="p_brand")


@query("event_panel", f"WITH {EVENTS} --result\nSELECT * FROM panel", ["sales"], ["date"])
def _(spark, folder):
    return events_of(spark, folder)


@query("gap_fill", f"WITH {FILLED} --result\nSELECT * FROM filled", MEASURES, ["date"])
def _(spark, folder):
    return filled_of(spark, folder)


def order_lines(spark, folder):
    """Raw order lines as a panel with many rows per key, for the operators that take rows before cleaning."""
    return table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_returnflag").alias("store_id"),
        F.col("l_linestatus").alias("item_id"), F.col("l_quantity").alias("sales"),
        F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line_no"),
    )


LINES = """
lines AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS store_id, l_linestatus AS item_id, l_quantity AS sales,
         l_orderkey AS order_no, l_linenumber AS line_no
  FROM lineitem)"""


@query(
    "dedup_first",
    f"""WITH {LINES} --result
    SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY date, {K} ORDER BY order_no, line_no, sales) AS n FROM lines)
    WHERE n = 1""",
    ["sales"],
    ["date"],
)
def _(spark, folder):
    return clean.drop_duplicates(order_lines(spark, folder), order_by=["order_no", "line_no", "sales"])


FENCES = """
fences AS (
  SELECT quantile_cont(sales, 0.25) - 1.5 * (quantile_cont(sales, 0.75) - quantile_cont(sales, 0.25)) AS s_lo,
         quantile_cont(sales, 0.75) + 1.5 * (quantile_cont(sales, 0.75) - quantile_cont(sales, 0.25)) AS s_hi,
         quantile_cont(price, 0.25) - 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS p_lo,
         quantile_cont(price, 0.75) + 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS p_hi,
         quantile_cont(temperature, 0.25) - 1.5 * (quantile_cont(temperature, 0.75) - quantile_cont(temperature, 0.25)) AS t_lo,
         quantile_cont(temperature, 0.75) + 1.5 * (quantile_cont(temperature, 0.75) - quantile_cont(temperature, 0.25)) AS t_hi,
         quantile_cont(precipitation, 0.25) - 1.5 * (quantile_cont(precipitation, 0.75) - quantile_cont(precipitation, 0.25)) AS r_lo,
         quantile_cont(precipitation, 0.75) + 1.5 * (quantile_cont(precipitation, 0.75) - quantile_cont(precipitation, 0.25)) AS r_hi
  FROM panel)"""


@query(
    "iqr_cap",
    f"""WITH {PANEL}, {FENCES} --result
    SELECT date, store_id, item_id, greatest(least(sales, s_hi), s_lo) AS sales, on_promo,
           greatest(least(price, p_hi), p_lo) AS price, greatest(least(temperature, t_hi), t_lo) AS temperature,
           greatest(least(precipitation, r_hi), r_lo) AS precipitation
    FROM panel, fences""",
    MEASURES,
    ["date"],
)
def _(spark, folder):
    return clean.cap_outliers(panel_of(spark, folder))


@query(
    "cleaning_flags",
    f"""WITH {FILLED}, {FENCES} --result
    SELECT date, store_id, item_id, sales, coalesce(sales < s_lo OR sales > s_hi, false) AS is_outlier, sales IS NULL AS is_missing
    FROM filled, fences""",
    ["sales"],
    ["date"],
)
def _(spark, folder):
    from shelfcast.operators.quantiles import iqr_bounds

    p = panel_of(spark, folder)
    flagged = clean.add_cleaning_flags(clean.fill_calendar_gaps(p), iqr_bounds(p, ["sales"])["sales"])
    return flagged.select("date", "store_id", "item_id", "sales", "is_outlier", "is_missing")


IMPUTED = f"""
imputed AS (
  SELECT date, {K},
    coalesce(last_value(sales IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING),
             first_value(sales IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS sales,
    coalesce(on_promo, 0) AS on_promo,
    coalesce(price, (SELECT quantile_cont(price, 0.5) FROM filled)) AS price,
    coalesce(temperature, (SELECT quantile_cont(temperature, 0.5) FROM filled)) AS temperature,
    coalesce(precipitation, (SELECT quantile_cont(precipitation, 0.5) FROM filled)) AS precipitation
  FROM filled)"""


@query("impute", f"WITH {FILLED}, {IMPUTED} --result\nSELECT * FROM imputed", MEASURES, ["date"])
def _(spark, folder):
    return clean.impute_defaults(clean.impute_median(clean.impute_sales(filled_of(spark, folder))))


@query(
    "clean_panel",
    f"""WITH {FILLED}, {FENCES},
    capped AS (SELECT date, store_id, item_id, greatest(least(sales, s_hi), s_lo) AS sales, on_promo,
           greatest(least(price, p_hi), p_lo) AS price, greatest(least(temperature, t_hi), t_lo) AS temperature,
           greatest(least(precipitation, r_hi), r_lo) AS precipitation,
           coalesce(sales < s_lo OR sales > s_hi, false) AS is_outlier
    FROM filled, fences) --result
    SELECT * REPLACE (
        CASE WHEN sales IS NULL THEN NULL ELSE sales END AS sales, CASE WHEN price IS NULL THEN NULL ELSE price END AS price),
        sales IS NULL AS is_missing
    FROM (SELECT c.date, c.store_id, c.item_id,
                 CASE WHEN f.sales IS NULL THEN NULL ELSE c.sales END AS sales, c.on_promo,
                 CASE WHEN f.price IS NULL THEN NULL ELSE c.price END AS price,
                 CASE WHEN f.temperature IS NULL THEN NULL ELSE c.temperature END AS temperature,
                 CASE WHEN f.precipitation IS NULL THEN NULL ELSE c.precipitation END AS precipitation, c.is_outlier
          FROM capped c JOIN filled f USING (date, store_id, item_id))""",
    MEASURES,
    ["date"],
)
def _(spark, folder):
    return clean.clean(panel_of(spark, folder))


@query(
    "cleaning_summary",
    f"""WITH {FILLED}, {FENCES},
    flagged AS (SELECT f.*, coalesce(sales < s_lo OR sales > s_hi, false) AS is_outlier, sales IS NULL AS is_missing FROM filled f, fences),
    o AS (SELECT count(*) AS n, {', '.join(f"count(*) - count({c}) AS {c}" for c in ["date", "store_id", "item_id", "sales", "on_promo", "price", "temperature", "precipitation"])} FROM panel),
    c AS (SELECT count(*) AS n, {', '.join(f"count(*) - count({c}) AS {c}" for c in ["date", "store_id", "item_id", "sales", "on_promo", "price", "temperature", "precipitation", "is_outlier", "is_missing"])},
          count(*) FILTER (WHERE is_outlier) AS fo, count(*) FILTER (WHERE is_missing) AS fm FROM flagged) --result
    SELECT 'rows_original' AS metric, CAST(n AS BIGINT) AS value FROM o UNION ALL SELECT 'rows_cleaned', n FROM c
    UNION ALL SELECT 'rows_removed', o.n - c.n FROM o, c
    {' '.join(f"UNION ALL SELECT 'nulls_original_{c}', {c} FROM o" for c in ["date", "store_id", "item_id", "sales", "on_promo", "price", "temperature", "precipitation"])}
    {' '.join(f"UNION ALL SELECT 'nulls_cleaned_{c}', {c} FROM c" for c in ["date", "store_id", "item_id", "sales", "on_promo", "price", "temperature", "precipitation", "is_outlier", "is_missing"])}
    UNION ALL SELECT 'is_outlier_flagged', fo FROM c UNION ALL SELECT 'is_missing_flagged', fm FROM c""",
)
def _(spark, folder):
    p = panel_of(spark, folder)
    return clean.cleaning_summary(p, clean.clean(p))


# --- validation -----------------------------------------------------------------------------


@query(
    "flag_invalid_rows",
    f"""WITH {PANEL} --result
    SELECT date, {K}, array_to_string(list_filter([
        CASE WHEN temperature < 0 THEN 'sales must be >= 0' END,
        CASE WHEN NOT (CAST(precipitation AS INTEGER) IN (0, 1)) THEN 'on_promo must be 0 or 1' END,
        CASE WHEN temperature - 20 <= 0 THEN 'price must be > 0' END,
        CASE WHEN precipitation - 5 < 0 THEN 'precipitation must be >= 0' END], lambda x: x IS NOT NULL), '; ') AS errors
    FROM panel""",
    dates=["date"],
)
def _(spark, folder):
    # Columns are shifted so that every rule is broken by some rows.
    p = panel_of(spark, folder)
    bad = p.select("date", "store_id", "item_id", F.col("temperature").alias("sales"),
                   F.col("precipitation").cast("int").alias("on_promo"), (F.col("temperature") - 20).alias("price"),
                   (F.col("precipitation") - 5).alias("precipitation"))
    return validate.flag_invalid_rows(bad).select("date", "store_id", "item_id", F.array_join("errors", "; ").alias("errors"))


@query(
    "validation_results",
    f"""WITH {FILLED} --result
    SELECT count(*) = count(DISTINCT (date, store_id, item_id)) AND count(date) = count(*) AS valid_series,
      min(sales) >= 0 AS no_negative_sales, count(*) FILTER (WHERE on_promo IS NULL OR on_promo NOT IN (0, 1)) = 0 AS raw_flags_valid,
      count(*) FILTER (WHERE on_promo NOT IN (0, 1)) = 0 AS clean_flags_valid FROM filled""",
)
def _(spark, folder):
    p = filled_of(spark, folder)

    def passes(check, *args, **kw) -> bool:
        try:
            check(*args, **kw)
            return True
        except ValueError:
            return False

    found = {
        "valid_series": validate.validate_series(as_panel(p)),
        "no_negative_sales": passes(validate.validate_raw, p.withColumn("on_promo", F.lit(0))),
        "raw_flags_valid": passes(validate.validate_raw, p),
        "clean_flags_valid": passes(validate.validate_clean, p),
    }
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in found.items()])


@query("read_parquet", "SELECT * FROM supplier", ["s_acctbal"])
def _(spark, folder):
    return files.load_data(spark, path=f"{folder}/supplier.parquet")


@query("read_directory", "SELECT * FROM part", ["p_retailprice"])
def _(spark, folder):
    return files.load_data(spark, directory=folder, pattern="part.parquet")


# --- profiling ------------------------------------------------------------------------------


@query(
    "data_summary",
    f"""WITH {PANEL} --result
    SELECT count(*) AS n_rows, CAST(8 AS INTEGER) AS n_columns, min(date) AS start, max(date) AS "end",
      CAST(date_diff('day', min(date), max(date)) AS INTEGER) AS days, count(DISTINCT store_id) AS n_stores,
      count(DISTINCT item_id) AS n_items, sum(sales) AS sales_total, avg(sales) AS sales_mean,
      quantile_cont(sales, 0.5) AS sales_median, stddev_samp(sales) AS sales_std, min(sales) AS sales_min, max(sales) AS sales_max,
      CAST(sum(on_promo) AS BIGINT) AS promo_days, avg(on_promo) * 100 AS promo_pct
    FROM panel""",
    ["sales_total", "sales_mean", "sales_median", "sales_std", "sales_min", "sales_max", "promo_pct"],
    ["start", "end"],
)
def _(spark, folder):
    return profile.data_summary(panel_of(spark, folder))


@query("first_ids", f"WITH {PANEL} --result\nSELECT DISTINCT store_id FROM panel ORDER BY store_id LIMIT 10")
def _(spark, folder):
    return profile.first_ids(panel_of(spark, folder), "store_id")


COLUMNS = ["date", "store_id", "item_id", "sales", "on_promo", "price", "temperature", "precipitation"]
TYPES = {"date": "date", "store_id": "string", "item_id": "string", "on_promo": "int"}


@query(
    "table_info",
    f"""WITH {FILLED} --result
    {' UNION ALL '.join(f"SELECT '{c}' AS \"column\", '{TYPES.get(c, 'double')}' AS type, count(*) - count({c}) AS n_null, count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM filled)) AS n_copies FROM filled" for c in COLUMNS)}""",
)
def _(spark, folder):
    return profile.table_info(filled_of(spark, folder))


@query(
    "fingerprint",
    f"""WITH {FILLED} --result
    {' UNION ALL '.join(f"SELECT 'run' AS run_id, 'nulls.{c}' AS name, CAST(count(*) - count({c}) AS VARCHAR) AS value FROM filled" for c in COLUMNS)}
    UNION ALL SELECT 'run', 'rows', CAST(count(*) AS VARCHAR) FROM filled
    UNION ALL SELECT 'run', 'columns', '8'""",
)
def _(spark, folder):
    return profile.fingerprint(filled_of(spark, folder), "run")


@query(
    "column_cardinality",
    f"""WITH {PANEL} --result
    {' UNION ALL '.join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM panel" for c in COLUMNS)}""",
)
def _(spark, folder):
    return profile.column_cardinality(panel_of(spark, folder))


@query(
    "missingness",
    f"""WITH {FILLED},
    per AS ({' UNION ALL '.join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, count(*) AS n FROM filled" for c in COLUMNS)}) --result
    SELECT \"column\", CAST(n_null AS BIGINT) AS n_null, CAST(n_null AS DOUBLE) / n * 100 AS pct_null FROM per
    UNION ALL SELECT '*', CAST(sum(n_null) AS BIGINT), CAST(sum(n_null) AS DOUBLE) / CAST(sum(n) AS DOUBLE) * 100 FROM per""",
    ["pct_null"],
)
def _(spark, folder):
    return profile.missingness(filled_of(spark, folder))


@query(
    "missing_runs",
    f"""WITH {FILLED},
    marked AS (SELECT {K}, sales, row_number() OVER ({W}) - row_number() OVER (PARTITION BY {K}, sales IS NULL ORDER BY date) AS g FROM filled),
    runs AS (SELECT {K}, g, count(*) AS len FROM marked WHERE sales IS NULL GROUP BY {K}, g) --result
    SELECT {K}, count(*) AS n_runs, CAST(sum(len) AS BIGINT) AS n_missing, max(len) AS max_run, avg(len) AS avg_run FROM runs GROUP BY {K}""",
    ["avg_run"],
)
def _(spark, folder):
    return profile.missing_runs(filled_of(spark, folder))


@query(
    "duplicate_stats",
    """WITH lines AS (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS store_id, l_linestatus AS item_id, l_quantity AS sales FROM lineitem) --result
    SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lines)) AS exact_copies,
      CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lines)) AS DOUBLE) / count(*) * 100 AS exact_copies_pct,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT date, store_id, item_id FROM lines)) AS copies_by_key,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT store_id, item_id FROM lines)) AS copies_by_series
    FROM lines""",
    ["exact_copies_pct"],
)
def _(spark, folder):
    return profile.duplicate_stats(order_lines(spark, folder).drop("order_no", "line_no"))


NUMERIC = ["sales", "on_promo", "price", "temperature", "precipitation"]


@query(
    "outlier_stats",
    f"""WITH {PANEL},
    s AS ({' UNION ALL '.join(f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM panel" for c in NUMERIC)}),
    v AS ({' UNION ALL '.join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM panel" for c in NUMERIC)}),
    c AS (SELECT \"column\", median, mean, std, min, max, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper,
          count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS iqr_count,
          count(*) FILTER (WHERE std > 0 AND abs((x - mean) / std) > 3) AS z_count, count(*) AS n
          FROM v JOIN s USING (\"column\") GROUP BY ALL) --result
    SELECT \"column\", iqr_count, z_count, lower, upper, mean, median, std, min, max,
      CAST(iqr_count AS DOUBLE) / n * 100 AS iqr_pct, CAST(z_count AS DOUBLE) / n * 100 AS z_pct FROM c""",
    ["lower", "upper", "mean", "median", "std", "min", "max", "iqr_pct", "z_pct"],
)
def _(spark, folder):
    return profile.outlier_stats(panel_of(spark, folder))


ORDER_DAYS = """
days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"""


@query(
    "missing_dates",
    f"""WITH {ORDER_DAYS},
    every AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM days) --result
    SELECT date FROM every WHERE date NOT IN (SELECT date FROM days)""",
    dates=["date"],
)
def _(spark, folder):
    return profile.missing_dates(table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("date")))


@query(
    "completeness",
    f"""WITH {PANEL} --result
    SELECT {K}, count(*) AS total_days, CAST(date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS BIGINT) AS missing_days,
      CAST(count(*) AS DOUBLE) / (date_diff('day', min(date), max(date)) + 1) * 100 AS completeness FROM panel GROUP BY {K}""",
    ["completeness"],
)
def _(spark, folder):
    return profile.series_completeness(panel_of(spark, folder))


@query(
    "series_info",
    f"""WITH {FILLED} --result
    SELECT {K}, min(date) AS start, max(date) AS "end", count(*) AS length, count(*) - count(sales) AS n_missing, avg(sales) AS mean,
      stddev_samp(sales) AS std, min(sales) AS min, max(sales) AS max, store_id || '_' || item_id AS series FROM filled GROUP BY {K}""",
    ["mean", "std", "min", "max"],
    ["start", "end"],
)
def _(spark, folder):
    return panels.series_info(as_panel(filled_of(spark, folder)))


@query("series_count", f"WITH {PANEL} --result\nSELECT count(*) AS n_series FROM (SELECT DISTINCT {K} FROM panel)")
def _(spark, folder):
    return panels.series_count(panel_of(spark, folder))


@query("date_range", f'WITH {PANEL} --result\nSELECT min(date) AS start, max(date) AS "end" FROM panel', dates=["start", "end"])
def _(spark, folder):
    return panels.date_range(panel_of(spark, folder))


@query(
    "histogram",
    f"""WITH {PANEL}, b AS (SELECT min(sales) AS lo, max(sales) AS hi, (max(sales) - min(sales)) / 50 AS step FROM panel),
    c AS (SELECT CAST(least(floor((sales - lo) / ((hi - lo) / 50)) + 1, 50) AS INTEGER) AS bin FROM panel, b) --result
    SELECT bin, lo + (bin - 1) * step AS lower, lo + bin * step AS upper, (SELECT count(*) FROM c WHERE c.bin = bins.bin) AS n
    FROM (SELECT CAST(i AS INTEGER) AS bin FROM range(1, 51) r(i)) bins, b""",
    ["lower", "upper"],
)
def _(spark, folder):
    return profile.value_histogram(panel_of(spark, folder), "sales", 50)


@query("daily_totals", f"WITH {PANEL} --result\nSELECT date, sum(sales) AS total_sales FROM panel GROUP BY date", ["total_sales"], ["date"])
def _(spark, folder):
    return profile.daily_totals(panel_of(spark, folder))


@query(
    "kpis",
    f"""WITH {PANEL} --result
    SELECT {K}, sum(sales) AS total_sales, avg(sales) AS mean_sales, CAST(sum(on_promo) AS BIGINT) AS promo_days, avg(price) AS mean_price
    FROM panel GROUP BY {K}""",
    ["total_sales", "mean_sales", "mean_price"],
)
def _(spark, folder):
    return profile.overview_kpis(panel_of(spark, folder))


# --- splits and selections ------------------------------------------------------------------


@query(
    "date_split",
    f"""WITH {PANEL} --result
    SELECT CASE WHEN date <= DATE '1999-12-31' THEN 'train' WHEN date >= DATE '2001-01-01' THEN 'test' ELSE 'val' END AS part, *
    FROM panel WHERE date <= DATE '1999-12-31' OR date >= DATE '2000-01-15'""",
    MEASURES,
    ["date"],
)
def _(spark, folder):
    parts = panels.split_by_date(as_panel(panel_of(spark, folder)), *[F.to_date(F.lit(d)) for d in ("1999-12-31", "2000-01-15", "2001-01-01")])
    named = zip(("train", "val", "test"), parts)
    return panels.union_all([p.df.select(F.lit(n).alias("part"), *p.df.columns) for n, p in named])


@query(
    "date_split_open",
    f"WITH {PANEL} --result\nSELECT * FROM panel WHERE date >= DATE '2000-01-15' AND date < (SELECT max(date) FROM panel)",
    MEASURES,
    ["date"],
)
def _(spark, folder):
    days = [F.to_date(F.lit(d)) for d in ("1999-12-31", "2000-01-15")]
    return panels.split_by_date(as_panel(panel_of(spark, folder)), *days)[1].df


@query(
    "series_semi",
    f"WITH {PANEL} --result\nSELECT * FROM panel WHERE (store_id, item_id) IN (SELECT {K} FROM panel GROUP BY {K} HAVING avg(sales) > (SELECT avg(sales) FROM panel))",
    MEASURES,
    ["date"],
)
def _(spark, folder):
    p = panel_of(spark, folder)
    mean = p.agg(F.avg("sales")).scalar()
    busy = p.groupBy("store_id", "item_id").agg(F.avg("sales").alias("m")).where(F.col("m") > mean)
    return panels.filter_series(as_panel(p), busy).df


@query("recent", f"WITH {PANEL} --result\nSELECT * FROM panel WHERE date >= (SELECT max(date) FROM panel) - 7", MEASURES, ["date"])
def _(spark, folder):
    return panels.recent(panel_of(spark, folder))


@query(
    "rolling_origin_splits",
    f"""WITH {PANEL}, e AS (SELECT max(date) AS last FROM panel),
    f AS (SELECT i AS fold, last - CAST((6 - i) * 28 - 1 AS INTEGER) AS val_start FROM e, range(1, 6) t(i)) --result
    SELECT CAST(fold AS INTEGER) AS fold, {K}, count(*) FILTER (WHERE date <= val_start - 1) AS n_train,
      count(*) FILTER (WHERE date BETWEEN val_start AND val_start + 27) AS n_val FROM panel, f GROUP BY fold, {K}""",
)
def _(spark, folder):
    p = as_panel(panel_of(spark, folder))
    out = []
    for f in panels.rolling_origin_splits(p, 5, 28):
        train, val = panels.split_at(p, f)
        both = train.select("store_id", "item_id", F.lit(0).alias("v")).unionByName(val.select("store_id", "item_id", F.lit(1).alias("v")))
        out.append(both.groupBy("store_id", "item_id").agg(F.count_if(F.col("v") == 0).alias("n_train"), F.count_if(F.col("v") == 1).alias("n_val"))
                   .select(F.lit(f["fold"]).alias("fold"), "store_id", "item_id", "n_train", "n_val"))
    return panels.union_all(out)


@query(
    "topk",
    f"WITH {PANEL} --result\nSELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY sales DESC, date) AS n FROM panel) WHERE n <= 10",
    MEASURES,
    ["date"],
)
def _(spark, folder):
    return panels.top_k(panel_of(spark, folder), [F.desc("sales"), F.asc("date")], 10, by=["store_id", "item_id"])


@query(
    "model_matrix",
    f"""WITH {FILLED} --result
    SELECT date, {K}, coalesce(price, 0) AS x_price, coalesce(on_promo, 0) AS x_promo, coalesce(temperature, 0) AS x_temperature, sales AS label FROM filled""",
    ["x_price", "x_promo", "x_temperature", "label"],
    ["date"],
)
def _(spark, folder):
    m = to_model_matrix(filled_of(spark, folder), ["price", "on_promo", "temperature"])
    x = vector_to_array("features")
    return m.select("date", "store_id", "item_id", x[0].alias("x_price"), x[1].alias("x_promo"), x[2].alias("x_temperature"), "label")
