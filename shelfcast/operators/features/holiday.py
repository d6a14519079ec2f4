"""Holiday dimension, flags and distances."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.config import DATE

# US federal holidays with their first and last year. ("fixed", month, day) moves to the nearest
# working day; ("nth", month, weekday, n) is the n-th such weekday of the month, n = -1 the last.
ALWAYS = 9999
US_RULES = (
    ("New Year's Day", 1870, ALWAYS, "fixed", 1, 1, None),
    ("Martin Luther King Jr. Day", 1986, ALWAYS, "nth", 1, "MON", 3),
    ("Washington's Birthday", 1879, 1970, "fixed", 2, 22, None),
    ("Washington's Birthday", 1971, ALWAYS, "nth", 2, "MON", 3),
    ("Memorial Day", 1888, 1970, "fixed", 5, 30, None),
    ("Memorial Day", 1971, ALWAYS, "nth", 5, "MON", -1),
    ("Juneteenth National Independence Day", 2021, ALWAYS, "fixed", 6, 19, None),
    ("Independence Day", 1870, ALWAYS, "fixed", 7, 4, None),
    ("Labor Day", 1894, ALWAYS, "nth", 9, "MON", 1),
    ("Columbus Day", 1937, 1970, "fixed", 10, 12, None),
    ("Columbus Day", 1971, ALWAYS, "nth", 10, "MON", 2),
    ("Armistice Day", 1938, 1953, "fixed", 11, 11, None),
    ("Veterans Day", 1954, 1970, "fixed", 11, 11, None),
    ("Veterans Day", 1971, 1977, "nth", 10, "MON", 4),
    ("Veterans Day", 1978, ALWAYS, "fixed", 11, 11, None),
    ("Thanksgiving Day", 1870, 1938, "nth", 11, "THU", -1),
    ("Thanksgiving Day", 1942, ALWAYS, "nth", 11, "THU", 4),
    ("Christmas Day", 1870, ALWAYS, "fixed", 12, 25, None),
)
# Fixed value: the distance given where there is no holiday on that side.
NO_HOLIDAY = 365
# The calendar repeats after 400 years, weekdays included. With all rules in force from 2021 on, the years from
# FIRST_YEAR to LAST_YEAR therefore say all; later days are looked up a number of cycles earlier.
CYCLE_DAYS = 146_097
FIRST_YEAR, LAST_YEAR = 1870, 2422
# Days of a calendar (some 50 bytes each) that may be broadcast.
BROADCAST_DAYS = 250_000


def us_holidays(spark: SparkSession, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """(date, name) of all US federal holidays of the years, observed days included; one row per date."""
    # One partition: some 15 rows per year, so neither grouping nor ordering them shuffles.
    years = spark.range(first_year - 1, last_year + 2, 1, 1).select(F.col("id").cast("int").alias("y"))
    rules = []
    for name, since, until, kind, month, day, n in US_RULES:
        if kind == "fixed":
            d = F.make_date(F.col("y"), F.lit(month), F.lit(day))
        elif n > 0:
            d = F.date_add(F.next_day(F.date_sub(F.make_date(F.col("y"), F.lit(month), F.lit(1)), 1), day), 7 * (n - 1))
        else:
            d = F.next_day(F.date_sub(F.last_day(F.make_date(F.col("y"), F.lit(month), F.lit(1))), 7), day)
        rules.append(F.struct(F.lit(name).alias("name"), d.alias("date"), F.lit(kind).alias("kind"), F.lit(since).alias("since"), F.lit(until).alias("until")))
    days = years.select("y", F.explode(F.array(*rules)).alias("h")).where("y between h.since and h.until").select("h.*")
    shift = F.when(F.weekday("date") == 5, -1).when(F.weekday("date") == 6, 1)
    observed = days.where((F.col("kind") == "fixed") & shift.isNotNull()).select(
        F.concat("name", F.lit(" (observed)")).alias("name"), F.date_add("date", shift).alias("date")
    )
    both = days.select("name", "date").unionByName(observed)
    one = both.groupBy("date").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("name"))
    return one.where(F.year("date").between(first_year, last_year))


def holidays_between(holidays: DataFrame, start, end) -> DataFrame:
    return holidays.where(F.col("date").between(F.lit(start), F.lit(end)))


def holiday_calendar(holidays: DataFrame, first, last) -> DataFrame:
    """Every day from ``first`` to ``last`` with its holiday and the days to the next and from the last one.

    Built from spans between holidays, so it costs one small sort; the size is the number of days.
    """
    spark = holidays.sparkSession
    lo, hi = F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date")
    edge = spark.range(0, 1, 1, 1).select(lo.alias("date"), F.lit(None).cast("string").alias("name"))
    marks = holidays.select(F.col("date").cast("date").alias("date"), "name").where(F.col("date") >= lo)
    marks = marks.unionByName(edge).coalesce(1).groupBy("date").agg(F.max("name").alias("name"))
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    real = F.col("name").isNotNull()
    spans = marks.select(
        "date", "name",
        F.lead("date").over(w).alias("next"),
        F.when(F.lag("name").over(w).isNotNull(), F.lag("date").over(w)).alias("prev"),
    ).where(F.col("date") <= hi)
    end = F.least(F.coalesce(F.date_sub("next", 1), hi), hi)
    days = spans.withColumn("day", F.explode(F.sequence("date", end)))
    own = F.col("day") == F.col("date")
    before = F.when(own, F.col("prev")).otherwise(F.when(real, F.col("date")))
    return days.select(
        F.col("day").alias("date"),
        (own & real).alias("is_holiday"),
        F.when(own, F.col("name")).alias("holiday_name"),
        F.coalesce(F.datediff("next", "day"), F.lit(NO_HOLIDAY)).alias("days_to_holiday"),
        F.coalesce(F.datediff("day", before), F.lit(NO_HOLIDAY)).alias("days_from_holiday"),
    )


def add_holidays(df: DataFrame, holidays: DataFrame | None = None, date: str = DATE, prefix: str = "holiday_") -> DataFrame:
    """Holiday, and distances to the next and from the last one, of each day; any year.

    The day calendar spans FIRST_YEAR to LAST_YEAR for the US rules (some 200,000 days) and the period of ``holidays``
    for a table of your own; days outside follow from the ends. A calendar of up to BROADCAST_DAYS is broadcast.
    """
    day = F.col(date).cast("date")
    if holidays is None:
        first, last = dt.date(FIRST_YEAR, 1, 1), dt.date(LAST_YEAR, 12, 31)
        cal = holiday_calendar(us_holidays(df.sparkSession, FIRST_YEAR, LAST_YEAR + 1), first, last)
        over = F.datediff(day, F.lit(last))
        at = F.when(over > 0, F.date_sub(day, F.ceil(over / CYCLE_DAYS).cast("int") * CYCLE_DAYS)).otherwise(day)
        after = F.lit(NO_HOLIDAY)  # never used: no day is after the end
    else:
        first, last = holidays.agg(F.min(F.col("date").cast("date")), F.max(F.col("date").cast("date"))).first()
        cal = holiday_calendar(holidays, first or dt.date(2000, 1, 1), last or dt.date(2000, 1, 1))
        at, after = day, F.when(day > F.lit(last), F.datediff(day, F.lit(last)))
    before = F.when(day < F.lit(first), F.datediff(F.lit(first), day))
    cal = cal.select(F.col("date").alias("_day"), *[F.col(c).alias(f"{prefix}{c}") for c in cal.columns if c != "date"])
    small = first is None or (last - first).days <= BROADCAST_DAYS
    joined = df.join(F.broadcast(cal) if small else cal, at == F.col("_day"), "left").drop("_day")
    return joined.withColumns({
        f"{prefix}is_holiday": F.coalesce(f"{prefix}is_holiday", F.lit(False)),
        f"{prefix}days_to_holiday": F.coalesce(f"{prefix}days_to_holiday", before, F.lit(NO_HOLIDAY)),
        f"{prefix}days_from_holiday": F.coalesce(f"{prefix}days_from_holiday", after, F.lit(NO_HOLIDAY)),
    })
