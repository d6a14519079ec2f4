"""Requests, scoring inputs, scenarios, inventory and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import FILLED, K, PANEL, W, as_panel, filled_of, panel_of, query, trailing
from catalog.forecasting import KNOWN, NAIVE
from shelfcast.functions.normal import norm_cdf, norm_ppf
from shelfcast.functions.series import series_window
from shelfcast.functions.series import trailing as last_rows
from shelfcast.operators import baselines, drift, explain, inventory, scenario, scoring, validate
from shelfcast.sources.star import table

# --- requests -------------------------------------------------------------------------------

REQUESTS = """
requests AS (
  SELECT o_orderpriority AS store_id, CAST(o_orderkey AS VARCHAR) AS item_id, CAST(o_orderdate AS DATE) AS start_date,
    CAST(o_orderdate AS DATE) + CAST(o_custkey % 10 AS INTEGER) AS end_date, o_custkey, o_orderkey FROM orders)"""


def requests_of(spark, folder):
    """Each order as a request of up to ten days, with plans derived from its keys."""
    o = table(spark, folder, "orders")
    days = (F.col("o_custkey") % 10).cast("int")
    plan = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((F.col("o_orderkey") + i) % 3 == 0).cast("int"))
    price = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (5 + (F.col("o_custkey") + i) % 7).cast("double"))
    start = F.col("o_orderdate").cast("date")
    return o.select(F.col("o_orderpriority").alias("store_id"), F.col("o_orderkey").cast("string").alias("item_id"),
                    start.alias("start_date"), F.date_add(start, days).alias("end_date"), plan.alias("promo_plan"), price.alias("price_plan"))


EXPANDED = """
days AS (SELECT store_id, item_id, o_custkey, o_orderkey, start_date, i,
           CAST(start_date + i AS DATE) AS date FROM (SELECT *, CAST(unnest(range(0, date_diff('day', start_date, end_date) + 1)) AS INTEGER) AS i FROM requests)),
expanded AS (SELECT store_id, item_id, date, CASE WHEN i <= 4 AND (o_orderkey + i) % 3 = 0 THEN 1 ELSE 0 END AS on_promo,
           CASE WHEN i <= 2 THEN CAST(5 + (o_custkey + i) % 7 AS DOUBLE) END AS price FROM days)"""


@query("expand_requests", f"WITH {REQUESTS}, {EXPANDED} --result\nSELECT * FROM expanded", ["price"], ["date"])
def _(spark, folder):
    return scoring.expand_requests(requests_of(spark, folder))


@query(
    "validate_requests",
    f"""WITH {REQUESTS} --result
    SELECT store_id, item_id, array_to_string(list_filter([
      CASE WHEN o_orderkey % 5 = 0 THEN 'promo_plan must contain only 0 and 1' END,
      CASE WHEN o_custkey % 7 <> 3 AND least((o_custkey) % 7, (o_custkey + 1) % 7, (o_custkey + 2) % 7) = 0 THEN 'price_plan must be positive' END,
      CASE WHEN end_date <= start_date THEN 'end_date must be after start_date' END,
      CASE WHEN date_diff('day', start_date, end_date) > 365 THEN 'horizon must not exceed 365 days' END], lambda x: x IS NOT NULL), '; ') AS errors
    FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 11 = 0 THEN end_date + 400 ELSE end_date END AS end_date) FROM requests)""",
)
def _(spark, folder):
    # Some plans hold a 2, a zero price or a long horizon, so that every rule is broken by some rows.
    key = F.col("item_id").cast("long")
    r = requests_of(spark, folder)
    broken = r.withColumns({
        "promo_plan": F.when(key % 5 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.col("promo_plan")),
        "price_plan": F.transform("price_plan", lambda p: p - 5),
        "end_date": F.when(key % 11 == 0, F.date_add("end_date", 400)).otherwise(F.col("end_date")),
    })
    return validate.validate_forecast_requests(broken).select("store_id", "item_id", F.array_join("errors", "; ").alias("errors"))


@query(
    "validate_inventory_requests",
    """SELECT CAST(p_partkey AS VARCHAR) AS item_id, array_to_string(list_filter([
      CASE WHEN NOT (p_size / CAST(50 AS DOUBLE) BETWEEN 0.5 AND 0.999) THEN 'service_level must be in [0.5, 0.999]' END,
      CASE WHEN NOT (p_size * 9 - 20 BETWEEN 1 AND 365) THEN 'lead_time must be in [1, 365]' END,
      CASE WHEN p_retailprice - 950 < 0 THEN 'costs must be >= 0' END], lambda x: x IS NOT NULL), '; ') AS errors FROM part""",
)
def _(spark, folder):
    p = table(spark, folder, "part")
    r = p.select(F.col("p_partkey").cast("string").alias("item_id"), (F.col("p_size") / 50.0).alias("service_level"),
                 (F.col("p_size") * 9 - 20).alias("lead_time"), (F.col("p_retailprice") - 950).alias("holding_cost"), F.lit(1.0).alias("stockout_cost"))
    return validate.validate_inventory_requests(r).select("item_id", F.array_join("errors", "; ").alias("errors"))


VECTOR = {
    "day_of_week": "CAST(isodow(date) - 1 AS INTEGER)", "day_of_month": "CAST(day(date) AS INTEGER)", "week_of_year": "CAST(weekofyear(date) AS INTEGER)",
    "month": "CAST(month(date) AS INTEGER)", "quarter": "CAST(quarter(date) AS INTEGER)", "year": "CAST(year(date) AS INTEGER)",
    "is_month_start": "day(date) = 1", "is_month_end": "date = last_day(date)", "is_weekend": "isodow(date) >= 6",
    "is_holiday": "CAST(0 AS INTEGER)", "days_to_holiday": "CAST(30 AS INTEGER)", "days_from_holiday": "CAST(30 AS INTEGER)",
    **{c: "CAST(0 AS DOUBLE)" for c in scoring.HISTORY},
    "on_promo": "on_promo", "price": "coalesce(price, 1.0::DOUBLE)", "price_pct_change": "CAST(0 AS DOUBLE)", "promo_rolling_7": "on_promo",
    "annual_sin": "sin(2 * pi() * dayofyear(date) / 365.25::DOUBLE)", "annual_cos": "cos(2 * pi() * dayofyear(date) / 365.25::DOUBLE)",
    "monthly_sin": "sin(2 * pi() * month(date) / 12)", "monthly_cos": "cos(2 * pi() * month(date) / 12)",
    "weekly_sin": "sin(2 * pi() * (isodow(date) - 1) / 7)", "weekly_cos": "cos(2 * pi() * (isodow(date) - 1) / 7)",
}
FLAGS = ("is_month_start", "is_month_end", "is_weekend")
INTS = ("day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year", "is_holiday", "days_to_holiday", "days_from_holiday", "on_promo", "promo_rolling_7")
VECTOR_SQL = f"vector AS (SELECT store_id, item_id, date, {', '.join(f'{e} AS {c}' for c, e in VECTOR.items())} FROM expanded)"


@query("scoring_features", f"WITH {REQUESTS}, {EXPANDED}, {VECTOR_SQL} --result\nSELECT * FROM vector",
       [c for c in VECTOR if c not in FLAGS and c not in INTS], ["date"])
def _(spark, folder):
    return scoring.scoring_features(scoring.expand_requests(requests_of(spark, folder))).select("store_id", "item_id", "date", *scoring.FEATURES)


CELLS = ", ".join(f"CAST({c} AS DOUBLE)" for c in VECTOR)


@query(
    "fallback_interval",
    f"""WITH {REQUESTS}, {EXPANDED}, {VECTOR_SQL},
    u AS (SELECT store_id, item_id, date, price * 3 AS yhat, abs(price * 3) * 0.15 * (1 + 0.1 * list_stddev_pop([{CELLS}])) AS u FROM vector) --result
    SELECT store_id, item_id, date, yhat, greatest(yhat - u, 0) AS yhat_lower, yhat + u AS yhat_upper FROM u""",
    ["yhat", "yhat_lower", "yhat_upper"],
    ["date"],
)
def _(spark, folder):
    v = scoring.scoring_features(scoring.expand_requests(requests_of(spark, folder))).withColumn("yhat", F.col("price") * 3)
    return scoring.fallback_interval(v).select("store_id", "item_id", "date", "yhat", "yhat_lower", "yhat_upper")


@query(
    "explain_simple",
    f"""WITH {REQUESTS}, {EXPANDED}, {VECTOR_SQL},
    long AS ({' UNION ALL '.join(f"SELECT store_id, item_id, date, '{c}' AS feature, abs(CAST({c} AS DOUBLE)) AS importance FROM vector" for c in VECTOR)}) --result
    SELECT store_id, item_id, date, feature, importance, CAST(rank AS INTEGER) AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY store_id, item_id, date ORDER BY importance DESC, feature) AS rank FROM long) WHERE rank <= 5""",
    ["importance"],
    ["date"],
)
def _(spark, folder):
    v = scoring.scoring_features(scoring.expand_requests(requests_of(spark, folder)))
    return explain.explain_simple(v, 5)


# --- scenarios ------------------------------------------------------------------------------


@query(
    "scenario",
    f"""WITH {PANEL}, s AS (SELECT {K}, sum(sales) AS base_total, sum(sales * CASE WHEN on_promo = 1 THEN 1.2::DOUBLE ELSE 0.95::DOUBLE END) AS scenario_total FROM panel GROUP BY {K}) --result
    SELECT {K}, base_total, scenario_total, scenario_total - base_total AS impact, (scenario_total - base_total) / nullif(base_total, 0) * 100 AS impact_pct FROM s""",
    ["base_total", "scenario_total", "impact", "impact_pct"],
)
def _(spark, folder):
    base = panel_of(spark, folder).withColumn("yhat", F.col("sales"))
    changed = base.withColumn("yhat", F.col("sales") * F.when(F.col("on_promo") == 1, 1.2).otherwise(0.95))
    return scenario.scenario_compare(base, changed)


@query("scenario_plan")
def _(spark, folder):
    plan = scenario.scenario_plan(requests_of(spark, folder), promo_pct=30, price_change_pct=-10)
    return scoring.expand_requests(plan).groupBy("store_id").agg(F.count("*").alias("n"), F.avg("on_promo").alias("promo_share"), F.avg("price").alias("price"))


@query(
    "gain_and_savings",
    f"""WITH {PANEL} --result
    SELECT {K}, (stddev_samp(sales) - avg(abs(sales - 10))) / nullif(stddev_samp(sales), 0) * 100 AS gain,
      avg(sales) * 0.5 + min(sales) * 2.0 AS savings FROM panel GROUP BY {K}""",
    ["gain", "savings"],
)
def _(spark, folder):
    s = panel_of(spark, folder).groupBy("store_id", "item_id").agg(
        F.stddev_samp("sales").alias("a"), F.avg(F.abs(F.col("sales") - 10)).alias("b"), F.avg("sales").alias("m"), F.min("sales").alias("l"))
    return s.select("store_id", "item_id", scenario.accuracy_gain(F.col("a"), F.col("b")).alias("gain"),
                    scenario.inventory_savings(F.col("m"), F.lit(0.5), F.col("l"), F.lit(2.0)).alias("savings"))


# --- inventory ------------------------------------------------------------------------------

FORECAST = f"""
fc AS (SELECT date, {K}, avg(sales) OVER {trailing(14)} AS yhat, coalesce(stddev_samp(sales) OVER {trailing(14)}, 0) AS sd FROM panel),
forecasts AS (SELECT date, {K}, yhat, greatest(yhat - 1.28 * sd, 0) AS yhat_lower, yhat + 1.28 * sd AS yhat_upper FROM fc)"""


def forecasts_of(spark, folder):
    f = last_rows(series_window(), 14)
    sd = F.coalesce(F.stddev_samp("sales").over(f), F.lit(0.0))
    p = panel_of(spark, folder).withColumns({"yhat": F.avg("sales").over(f), "sd": sd})
    return p.select("date", "store_id", "item_id", "yhat", F.greatest(F.col("yhat") - 1.28 * F.col("sd"), F.lit(0.0)).alias("yhat_lower"),
                    (F.col("yhat") + 1.28 * F.col("sd")).alias("yhat_upper"))


# The quantiles the SQL needs, to double precision: 0.95 and 10 / 10.1.
Z95, Z10 = 1.6448536269514715, 2.3300789227879104
INVENTORY = ["expected_demand", "demand_std", "safety_stock", "reorder_point", "stockout_probability", "economic_order_quantity", "service_level", "holding_cost", "stockout_cost"]


@query(
    "inventory",
    f"""WITH {PANEL}, {FORECAST},
    first AS (SELECT *, row_number() OVER ({W}) AS n FROM forecasts),
    d AS (SELECT {K}, sum(yhat) AS expected_demand, greatest(avg(yhat_upper - yhat_lower) / 3.92, 0.1) AS demand_std FROM first WHERE n <= 7 GROUP BY {K}) --result
    SELECT {K}, expected_demand, demand_std, {Z95} * demand_std * sqrt(7) AS safety_stock, expected_demand + {Z95} * demand_std * sqrt(7) AS reorder_point,
      0.05 AS stockout_probability, greatest(sqrt(2 * expected_demand * 365 * 10 / 0.1), 1) AS economic_order_quantity, 0.95 AS service_level,
      CAST(7 AS INTEGER) AS lead_time, 0.1 AS holding_cost, 10.0 AS stockout_cost FROM d""",
    INVENTORY,
)
def _(spark, folder):
    return inventory.inventory_metrics(forecasts_of(spark, folder))


@query(
    "inventory_by_params",
    f"""WITH {PANEL}, {FORECAST},
    params AS (SELECT {K}, CAST(count(*) % 9 + 3 AS INTEGER) AS lead_time, CASE WHEN avg(on_promo) > 0.3 THEN 0.95 ELSE 0.5 END AS service_level FROM panel GROUP BY {K}),
    first AS (SELECT f.*, lead_time, service_level, row_number() OVER (PARTITION BY f.store_id, f.item_id ORDER BY date) AS n FROM forecasts f JOIN params p ON p.store_id = f.store_id AND p.item_id = f.item_id),
    d AS (SELECT {K}, lead_time, service_level, sum(yhat) AS expected_demand, greatest(avg(yhat_upper - yhat_lower) / 3.92, 0.1) AS demand_std FROM first WHERE n <= lead_time GROUP BY {K}, lead_time, service_level),
    z AS (SELECT *, CASE WHEN service_level > 0.9 THEN {Z95} ELSE 0 END AS z FROM d) --result
    SELECT {K}, expected_demand, demand_std, z * demand_std * sqrt(lead_time) AS safety_stock, expected_demand + z * demand_std * sqrt(lead_time) AS reorder_point,
      1 - service_level AS stockout_probability, greatest(sqrt(2 * expected_demand * 365 * 10 / 0.1), 1) AS economic_order_quantity, service_level, lead_time,
      0.1 AS holding_cost, 10.0 AS stockout_cost FROM z""",
    INVENTORY,
)
def _(spark, folder):
    p = panel_of(spark, folder)
    params = p.groupBy("store_id", "item_id").agg((F.count("*") % 9 + 3).cast("int").alias("lead_time"),
                                                  F.when(F.avg("on_promo") > 0.3, 0.95).otherwise(0.5).alias("service_level"))
    return inventory.inventory_metrics(forecasts_of(spark, folder), params)


NEWS = ["expected_demand", "demand_std", "eoq", "newsvendor_quantity", "service_level_95_reorder", "critical_ratio"]


@query(
    "newsvendor",
    f"""WITH {PANEL}, {FORECAST}, d AS (SELECT {K}, avg(yhat) AS m, stddev_pop(yhat) AS s FROM forecasts GROUP BY {K}) --result
    SELECT {K}, m AS expected_demand, s AS demand_std, greatest(sqrt(2 * m * 365 * 10 / 0.1), 1) AS eoq, greatest({Z10} * s + m, 0) AS newsvendor_quantity,
      greatest(m * 7 + {Z95} * s * sqrt(7), 0) AS service_level_95_reorder, 10 / 10.1::DOUBLE AS critical_ratio FROM d""",
    NEWS,
)
def _(spark, folder):
    return inventory.optimize_order_quantity(forecasts_of(spark, folder))


# The same rational approximation as in the library, as text.
CDF_P = "((((((3.52624965998911e-2*a+.700383064443688)*a+6.37396220353165)*a+33.912866078383)*a+112.079291497871)*a+221.213596169931)*a+220.206867912376)"
CDF_Q = "(((((((8.83883476483184e-2*a+1.75566716318264)*a+16.064177579207)*a+86.7807322029461)*a+296.564248779674)*a+637.333633378831)*a+793.826512519948)*a+440.413735824752)"
CDF_SQL = f"""CASE WHEN x > 0 THEN 1 - tail ELSE tail END FROM (SELECT *, CASE WHEN a < 7.07106781186547 THEN exp(-a*a/2) * {CDF_P} / {CDF_Q}
   ELSE exp(-a*a/2) / (a+1/(a+2/(a+3/(a+4/(a+.65))))) / 2.506628274631 END AS tail FROM (SELECT *, abs(x) AS a FROM xs))"""


@query("norm_cdf", f"""WITH {PANEL}, xs AS (SELECT date, {K}, (sales - 40) / CAST(10 AS DOUBLE) AS x FROM panel) --result
SELECT date, store_id, item_id, {CDF_SQL.replace('END FROM', 'END AS phi FROM', 1)}""", ["phi"], ["date"], digits=9)
def _(spark, folder):
    return panel_of(spark, folder).select("date", "store_id", "item_id", norm_cdf((F.col("sales") - 40) / 10).alias("phi"))


@query("norm_ppf", f"""WITH {PANEL} --result
SELECT date, {K}, (sales - 40) / CAST(100 AS DOUBLE) AS x FROM panel""", ["x"], ["date"], digits=9)
def _(spark, folder):
    # The inverse undoes the distribution function; on the side below zero no digits are lost.
    p = panel_of(spark, folder).select("date", "store_id", "item_id", ((F.col("sales") - 40) / 100).alias("y"))
    p = p.withColumn("p", norm_cdf(-F.abs("y")))
    return p.select("date", "store_id", "item_id", (-F.signum("y") * norm_ppf(F.col("p"))).alias("x"))


@query(
    "stockout_prob",
    f"""WITH {PANEL}, s AS (SELECT {K}, avg(sales) AS m, stddev_samp(sales) AS sd, max(sales) AS stock FROM panel GROUP BY {K}),
    xs AS (SELECT {K}, (stock - m * 7) / (sd * sqrt(7)) AS x FROM s) --result
    SELECT store_id, item_id, 1 - phi AS probability FROM (SELECT *, {CDF_SQL.replace('END FROM', 'END AS phi FROM', 1)})""",
    ["probability"],
)
def _(spark, folder):
    s = panel_of(spark, folder).groupBy("store_id", "item_id").agg(F.avg("sales").alias("m"), F.stddev_samp("sales").alias("sd"), F.max("sales").alias("stock"))
    p = inventory.stockout_probability(F.col("stock"), F.col("m"), F.col("sd"), F.lit(7))
    return s.select("store_id", "item_id", p.alias("probability"))


@query(
    "turnover",
    f"""WITH {PANEL}, s AS (SELECT {K}, sum(sales) AS total, avg(sales) - 27 AS stock FROM panel GROUP BY {K}) --result
    SELECT {K}, CASE WHEN stock > 0 THEN total / stock ELSE 0 END AS turnover, stock * 0.25 AS carrying_cost FROM s""",
    ["turnover", "carrying_cost"],
)
def _(spark, folder):
    s = panel_of(spark, folder).groupBy("store_id", "item_id").agg(F.sum("sales").alias("total"), (F.avg("sales") - 27).alias("stock"))
    return s.select("store_id", "item_id", inventory.turnover(F.col("total"), F.col("stock")).alias("turnover"),
                    inventory.carrying_cost(F.col("stock")).alias("carrying_cost"))


# --- drift ----------------------------------------------------------------------------------


def event_halves(spark, folder):
    e = table(spark, folder, "events").select("ts", "value", "event_type")
    cut = F.to_timestamp(F.lit("2024-01-16"))
    return e.where(F.col("ts") < cut).drop("ts"), e.where(F.col("ts") >= cut).drop("ts")


PROBS = ", ".join(repr(min(1.0, i * 0.1)) for i in range(11))
PSI = f"""
e AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-16'), a AS (SELECT value FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
q AS (SELECT list_sort(list_distinct(quantile_cont(value, [{PROBS}]))) AS edges FROM e),
bins AS (SELECT i, edges[i] AS lo, edges[i + 1] AS hi, i = len(edges) - 1 AS last FROM (SELECT edges, unnest(range(1, len(edges))) AS i FROM q)),
share AS (SELECT i, (SELECT count(*) FROM e WHERE value >= lo AND (value < hi OR (last AND value <= hi))) / CAST((SELECT count(*) FROM e) AS DOUBLE) AS pe,
                    (SELECT count(*) FROM a WHERE value >= lo AND (value < hi OR (last AND value <= hi))) / CAST((SELECT count(*) FROM a) AS DOUBLE) AS pa FROM bins)"""


@query("psi_num", f"WITH {PSI} --result\nSELECT 'value' AS feature, greatest(coalesce(sum((pa - pe) * ln(pa / pe)) FILTER (WHERE pa > 0 AND pe > 0), 0), 0) AS psi FROM share", ["psi"])
def _(spark, folder):
    return drift.psi_numeric(*event_halves(spark, folder), ["value"])


@query(
    "psi_cat",
    """WITH c AS (SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS e, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS a FROM events GROUP BY event_type),
    s AS (SELECT e / CAST(sum(e) OVER () AS DOUBLE) AS pe, a / CAST(sum(a) OVER () AS DOUBLE) AS pa FROM c) --result
    SELECT 'event_type' AS feature, greatest(coalesce(sum((pa - pe) * ln(pa / pe)) FILTER (WHERE pa > 0 AND pe > 0), 0), 0) AS psi FROM s""",
    ["psi"],
)
def _(spark, folder):
    return drift.psi_categorical(*event_halves(spark, folder), ["event_type"])


def panel_halves(spark, folder):
    p = filled_of(spark, folder)
    cut = F.to_date(F.lit("2000-01-01"))
    return p.where(F.col("date") >= cut), p.where(F.col("date") < cut)


def moments_sql(columns) -> str:
    parts = []
    for c in columns:
        for kind, f in (("mean", "avg"), ("std", "stddev_samp")):
            old, new = f"{f}({c}) FILTER (WHERE date < DATE '2000-01-01')", f"{f}({c}) FILTER (WHERE date >= DATE '2000-01-01')"
            parts.append(f"SELECT '{c}_{kind}_drift' AS metric, CASE WHEN {old} > 0 THEN abs({new} - {old}) / {old} ELSE 0 END AS value FROM filled")
    return " UNION ALL ".join(parts)


COLUMNS = ["date", "store_id", "item_id", "sales", "on_promo", "price", "temperature", "precipitation"]


def missing_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}_missing_drift' AS metric, abs(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FILTER (WHERE date >= DATE '2000-01-01')"
        f" - avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FILTER (WHERE date < DATE '2000-01-01')) AS value FROM filled" for c in COLUMNS)


@query("drift_stats", f"WITH {FILLED} --result\n{moments_sql(['sales', 'price', 'on_promo'])}", ["value"])
def _(spark, folder):
    return drift.moment_drift(*panel_halves(spark, folder))


@query("missing_drift", f"WITH {FILLED} --result\n{missing_sql()}", ["value"])
def _(spark, folder):
    return drift.missing_drift(*panel_halves(spark, folder))


@query(
    "drift_alerts",
    f"""WITH {FILLED}, m AS ({moments_sql(COLUMNS[3:])} UNION ALL {missing_sql()}) --result
    SELECT metric, value, severity, value > 0.05 AS over_threshold FROM (SELECT *, CASE WHEN metric LIKE '%\\_missing\\_drift' ESCAPE '\\' AND value > 0.1 THEN 'missing_data'
      WHEN value > 0.05 THEN 'drift' END AS severity FROM m) WHERE severity IS NOT NULL""",
    ["value"],
)
def _(spark, folder):
    new, old = panel_halves(spark, folder)
    found = drift.moment_drift(new, old, COLUMNS[3:]).unionByName(drift.missing_drift(new, old))
    return drift.drift_alerts(found, threshold=0.05)


@query(
    "prediction_drift",
    f"""WITH {FILLED}, {KNOWN}, f AS ({NAIVE}), n AS (SELECT {K}, date, sales AS yhat FROM f) --result
    SELECT 'prediction_mean_drift' AS metric, CASE WHEN (SELECT avg(sales) FROM filled) > 0 THEN abs(avg(yhat) - (SELECT avg(sales) FROM filled)) / (SELECT avg(sales) FROM filled) ELSE 0 END AS value FROM n
    UNION ALL SELECT 'prediction_std_drift', CASE WHEN (SELECT stddev_samp(sales) FROM filled) > 0 THEN abs(stddev_samp(yhat) - (SELECT stddev_samp(sales) FROM filled)) / (SELECT stddev_samp(sales) FROM filled) ELSE 0 END FROM n""",
    ["value"],
)
def _(spark, folder):
    p = filled_of(spark, folder)
    new = baselines.naive(as_panel(p), 28).select(F.col("sales").alias("yhat"))
    return drift.prediction_drift(new, p.select(F.col("sales").alias("yhat")))


def psi_panel(c: str) -> str:
    """Share of each quantile bin of the older half, in both halves of the filled panel."""
    return f"""
e_{c} AS (SELECT CAST({c} AS DOUBLE) AS v FROM filled WHERE date < DATE '2000-01-01' AND {c} IS NOT NULL),
a_{c} AS (SELECT CAST({c} AS DOUBLE) AS v FROM filled WHERE date >= DATE '2000-01-01' AND {c} IS NOT NULL),
q_{c} AS (SELECT list_sort(list_distinct(quantile_cont(v, [{PROBS}]))) AS edges FROM e_{c}),
b_{c} AS (SELECT i, edges[i] AS lo, edges[i + 1] AS hi, i = len(edges) - 1 AS last FROM (SELECT edges, unnest(range(1, len(edges))) AS i FROM q_{c})),
s_{c} AS (SELECT i, (SELECT count(*) FROM e_{c} WHERE v >= lo AND (v < hi OR (last AND v <= hi))) / CAST((SELECT count(*) FROM e_{c}) AS DOUBLE) AS pe,
                    (SELECT count(*) FROM a_{c} WHERE v >= lo AND (v < hi OR (last AND v <= hi))) / CAST((SELECT count(*) FROM a_{c}) AS DOUBLE) AS pa FROM b_{c}),
psi_{c} AS (SELECT '{c}_psi' AS metric, greatest(coalesce(sum((pa - pe) * ln(pa / pe)) FILTER (WHERE pa > 0 AND pe > 0), 0), 0) AS value FROM s_{c})"""


@query(
    "data_drift",
    f"""WITH {FILLED}, {','.join(psi_panel(c) for c in drift.FEATURES)} --result
    {moments_sql(drift.FEATURES)} UNION ALL {missing_sql()} {' '.join(f"UNION ALL SELECT * FROM psi_{c}" for c in drift.FEATURES)}""",
    ["value"],
)
def _(spark, folder):
    return drift.data_drift(*panel_halves(spark, folder))
