"""Run windows, climatology, deviations and coverage."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import q_round


def run_windows(runs: DataFrame) -> DataFrame:
    """(feed, run_date, start_date, end_date) that each run asks for; projections only on the first of a month."""
    day = F.col("run_date")
    window = lambda feed, a, b: F.struct(F.lit(feed).alias("feed"), a.alias("start_date"), b.alias("end_date"))
    asked = F.array(
        window("weather", day, F.date_add(day, 6)),
        window("air_quality", day, F.date_add(day, 4)),
        window("flood", day, F.date_add(day, 6)),
        window("historical", F.date_sub(day, 12), F.date_sub(day, 6)),
        F.when(F.dayofmonth(day) == 1, window("climate", day, F.add_months(F.trunc(day, "month"), 120))),
    )
    return runs.select("run_date", F.explode(F.filter(asked, lambda x: x.isNotNull())).alias("x")).select("x.feed", "run_date", "x.start_date", "x.end_date")


def climatology(daily: DataFrame) -> DataFrame:
    """Monthly means of every site from daily rows of any kind, in the shape of the normals."""
    return daily.groupBy("city_id", F.month("date").alias("month")).agg(
        q_round(F.avg("temperature_2m_mean"), 2).alias("normal_temperature_2m_mean"),
        q_round(F.avg("temperature_2m_max"), 2).alias("normal_temperature_2m_max"),
        q_round(F.avg("precipitation_sum_mm"), 2).alias("normal_daily_precipitation_mm"),
        q_round(F.avg("wind_speed_10m_max"), 2).alias("normal_wind_speed_10m_max"),
    )


MEASURES = {
    "temperature_2m_mean": "normal_temperature_2m_mean", "temperature_2m_max": "normal_temperature_2m_max",
    "precipitation_sum_mm": "normal_daily_precipitation_mm", "wind_speed_10m_max": "normal_wind_speed_10m_max",
}


def climatology_state(daily: DataFrame, sign: int = 1) -> DataFrame:
    """What climatology needs of daily rows, so that it can be added up: sums and counts of every (city_id, month).

    Sums are decimals, so they are the same in any order, and with sign=-1 take back rows that were revised."""
    sums = [(F.coalesce(F.sum(F.col(c).cast("decimal(28,9)")), F.lit(0)) * sign).cast("decimal(38,9)").alias(f"sum_{c}") for c in MEASURES]
    counts = [(F.count(c) * sign).alias(f"n_{c}") for c in MEASURES]
    return daily.groupBy("city_id", F.month("date").alias("month")).agg(*sums, *counts, (F.count(F.lit(1)) * sign).alias("days"))


def merged_climatology(*states: DataFrame) -> DataFrame:
    """One state of several; months whose days were all taken back fall away."""
    every = reduce(DataFrame.unionByName, states)
    numbers = [c for c in every.columns if c not in ("city_id", "month")]
    kinds = dict(every.dtypes)
    return every.groupBy("city_id", "month").agg(*(F.sum(c).cast(kinds[c]).alias(c) for c in numbers)).where("days > 0")


def climatology_of(state: DataFrame) -> DataFrame:
    """The monthly means of a state: equal to climatology() of its days."""
    mean = lambda c: F.when(F.col(f"n_{c}") > 0, F.round(F.col(f"sum_{c}") / F.col(f"n_{c}"), 2).cast("double"))
    return state.select("city_id", "month", *(mean(c).alias(n) for c, n in MEASURES.items()))


def forecast_deviation(raw: DataFrame, observed: DataFrame) -> DataFrame:
    """How far forecasts of every lead time stood from what was observed: days, mean error, mean absolute error."""
    day, made = F.to_date("valid_ts_utc"), F.to_date("ingested_at_utc")
    forecast = raw.groupBy("city_id", day.alias("date"), F.datediff(day, made).alias("lead_days")).agg(q_round(F.avg("temperature_2m"), 4).alias("forecast"))
    gap = F.col("forecast") - F.col("temperature_2m_mean")
    both = forecast.join(observed.select("city_id", "date", "temperature_2m_mean"), ["city_id", "date"]).where(gap.isNotNull())
    return both.groupBy(F.col("lead_days").cast("long").alias("lead_days")).agg(
        F.count(F.lit(1)).alias("days"), q_round(F.avg(gap), 4).alias("mean_error"), q_round(F.avg(F.abs(gap)), 4).alias("mean_abs_error")
    )


def projection_deviation(raw: DataFrame, normals: DataFrame) -> DataFrame:
    """Monthly projected maximum of every site and model against its normal."""
    months = raw.groupBy("city_id", "model", F.year("date").alias("year"), F.month("date").alias("month")).agg(q_round(F.avg("temperature_2m_max"), 4).alias("projected"))
    base = normals.select("city_id", F.col("month").cast("int").alias("month"), "normal_temperature_2m_max")
    return months.join(base, ["city_id", "month"]).withColumn("deviation", q_round(F.col("projected") - F.col("normal_temperature_2m_max"), 4))


def coverage_gaps(sites: DataFrame, feeds: tuple[str, ...], loaded: DataFrame, first: date, last: date) -> DataFrame:
    """(city_id, feed, date) expected from first to last but not loaded; the flood feed is expected of river
    sites only. Each site is expanded to its feeds and days, and what is loaded is taken away."""
    wanted = sites.select("city_id", "river_enabled", F.explode(F.array(*map(F.lit, feeds))).alias("feed"))
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    wanted = wanted.where((F.col("feed") != "flood") | F.col("river_enabled")).select("city_id", "feed", F.explode(days).alias("date"))
    return wanted.join(loaded, ["city_id", "feed", "date"], "left_anti")
