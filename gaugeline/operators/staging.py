"""Latest revisions, daily rollups and the panel of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import q_round


def latest(df: DataFrame, keys: list[str], order_by: str = "ingested_at_utc", tiebreak: tuple[str, ...] = ("ingestion_run_id",)) -> DataFrame:
    """The newest row of every key, nulls and all. Map tasks keep one row a key before the shuffle."""
    order = [F.desc(c) for c in (order_by, *(t for t in tiebreak if t in df.columns))]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


TIES = ("ingestion_run_id", "payload_pos", "event_id")


def latest_weather(raw: DataFrame) -> DataFrame:
    return latest(raw, ["city_id", "valid_ts_utc"], tiebreak=TIES)


latest_air = latest_weather


def latest_river(raw: DataFrame) -> DataFrame:
    return latest(raw, ["city_id", "date"], tiebreak=TIES)


latest_observed = latest_river


def _or_zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def daily_weather(hours: DataFrame) -> DataFrame:
    return hours.groupBy("city_id", F.to_date("valid_ts_utc").alias("date")).agg(
        q_round(F.avg("temperature_2m"), 2).alias("temperature_2m_mean"),
        q_round(F.max("temperature_2m"), 2).alias("temperature_2m_max"),
        q_round(F.min("temperature_2m"), 2).alias("temperature_2m_min"),
        q_round(F.sum(_or_zero("precipitation_mm")), 2).alias("precipitation_sum_mm"),
        q_round(F.max(_or_zero("wind_speed_10m")), 2).alias("wind_speed_10m_max"),
        q_round(F.max(_or_zero("wind_gusts_10m")), 2).alias("wind_gusts_10m_max"),
        F.max("weather_code").alias("weather_code_max"),
        F.count(F.lit(1)).alias("hour_count"),
    )


def daily_air(hours: DataFrame) -> DataFrame:
    """Means count a missing reading as 0; the largest index skips it."""
    mean = lambda c, to: q_round(F.avg(_or_zero(c)), 2).alias(to)
    return hours.groupBy("city_id", F.to_date("valid_ts_utc").alias("date")).agg(
        mean("european_aqi", "european_aqi_mean"),
        F.max("european_aqi").alias("european_aqi_max"),
        mean("pm2_5", "pm2_5_mean"),
        mean("pm10", "pm10_mean"),
        mean("no2", "no2_mean"),
        mean("o3", "o3_mean"),
        F.count(F.lit(1)).alias("hour_count"),
    )


OBSERVED = ("temperature_2m_mean", "temperature_2m_max", "temperature_2m_min", "precipitation_sum_mm", "wind_speed_10m_max")


def bucketed(df: DataFrame, name: str, path: str, buckets: int = 200) -> DataFrame:
    """Stores daily rows as a table of the catalog with its files under path, bucketed and sorted by (city_id, date).

    signal_panel over tables of equally many buckets shuffles nothing. A bucket is one file, so that its order
    holds; choose so many buckets that one fits a task."""
    on = ["city_id", "date"]
    writer = df.repartition(buckets, *on).write.bucketBy(buckets, *on).sortBy(*on).option("path", path).mode("overwrite")
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def signal_panel(weather: DataFrame, air: DataFrame, river: DataFrame, observed: DataFrame) -> DataFrame:
    """One row per (city_id, date) of weather, with what the other feeds hold for it. All sides share
    the key, so each is shuffled once and no join shuffles again."""
    on = ["city_id", "date"]
    return (
        weather.drop("hour_count")
        .join(air.drop("hour_count"), on, "left")
        .join(river.select(*on, "river_discharge_m3s"), on, "left")
        .join(observed.select(*on, *(F.col(c).alias(f"hist_{c}") for c in OBSERVED)), on, "left")
    )
