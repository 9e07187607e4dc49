"""Days, weekdays and seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A Monday from which weekdays are counted.
MONDAY = "1900-01-01"


def _weekdays_before(day: Column) -> Column:
    n = F.datediff(day, F.lit(MONDAY).cast("date"))
    week = F.floor(n / 7)
    return 5 * week + F.least(n - 7 * week, F.lit(5))


def weekdays_between(start: Column, end: Column) -> Column:
    """Weekdays in [start, end); 0 if end is not after start. In closed form."""
    return F.greatest(_weekdays_before(end) - _weekdays_before(start), F.lit(0)).cast("bigint")


def next_weekday(day: Column) -> Column:
    """The day itself, or the Monday after a weekend."""
    w = F.weekday(day)
    return F.when(w >= 5, F.date_add(day, 7 - w)).otherwise(day)


def with_season(rows: DataFrame, day: str, seasons: DataFrame) -> DataFrame:
    """`rows` with `season_key`: the season whose months hold the day's month. Seasons that overlap give several rows, gaps none; `season_cover` tells."""
    months = seasons.select(F.col("key").alias("season_key"), F.explode("months").alias("_month"))
    return rows.join(months, F.month(day) == F.col("_month")).drop("_month")


def season_cover(seasons: DataFrame) -> DataFrame:
    """(month, n): how many seasons hold each month; the data are sound if every n is 1."""
    months = seasons.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    held = seasons.select(F.explode("months").alias("month")).groupBy("month").agg(F.count("*").alias("n"))
    return months.join(held, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def month_grid(months: DataFrame, month: str) -> DataFrame:
    """(month, week, slot, day): the Monday-first calendar of each month; days outside the month are null. months: first days of months."""
    first, last = F.col(month), F.last_day(month)
    lead = F.weekday(first)
    cells = F.ceil((lead + F.day(last)) / 7) * 7
    rows = months.select(F.col(month).alias("month"), F.explode(F.sequence(F.lit(0), (cells - 1).cast("int"))).alias("cell"), lead.alias("lead"))
    day = F.date_add("month", (F.col("cell") - F.col("lead")).cast("int"))
    return rows.select("month", F.floor(F.col("cell") / 7).cast("int").alias("week"), (F.col("cell") % 7).cast("int").alias("slot"), F.when(F.trunc(day, "month") == F.col("month"), day).alias("day"))
