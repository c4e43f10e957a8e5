"""Raw tables derived from the test events, and payloads made of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions import q_round
from gaugeline.operators.staging import daily_weather, latest_weather
from gaugeline.sources.feeds import AIR, OBSERVED, PROJECTION, RIVER, WEATHER, Feed

RIVER_SITES = (0, 5, 7)
NO_NORMAL = 9


@dataclass(frozen=True)
class Raw:
    weather: DataFrame
    air: DataFrame
    river: DataFrame
    observed: DataFrame
    projection: DataFrame


def events(spark: SparkSession, sf_dir: str, n_sites: int = 10) -> DataFrame:
    site = F.col("user_id") % n_sites
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        "event_type",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        site.alias("site"),
        (site % 10).alias("kind"),
        F.concat(F.lit("site_"), site.cast("string")).alias("city_id"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("valid_ts_utc"),
        F.to_date("ts").alias("date"),
        F.dayofmonth("ts").cast("long").alias("dom"),
        F.round(F.col("value") * 100).cast("long").alias("c"),
        (F.col("event_id") * 37 % 100).alias("k"),
    )


def _part(m: int) -> Column:
    return F.col("c") % m / F.lit(100.0)


def _stamped(df: DataFrame, days: Column, *columns: Column) -> DataFrame:
    at = (F.col("ts") + F.make_dt_interval(days)).cast("timestamp")
    return df.select(
        F.concat(F.lit("run_"), F.to_date(at).cast("string")).alias("ingestion_run_id"), at.alias("ingested_at_utc"), "city_id", *columns, "event_id"
    )


def raw_tables(spark: SparkSession, sf_dir: str, n_sites: int = 10) -> Raw:
    e = events(spark, sf_dir, n_sites)
    e_id, dom, kind, k = F.col("event_id"), F.col("dom"), F.col("kind"), F.col("k")
    none = lambda cond, c: F.when(~cond, c)
    week = (-(e_id % 7)).cast("int")
    weather = _stamped(
        e.where(F.col("event_type").isin("click", "view", "error")), week, F.col("valid_ts_utc"),
        none(e_id % 17 == 0, _part(1000) + (dom * 7 + kind * 3) % 15).alias("temperature_2m"),
        F.when(k < 20, _part(1200)).when(k < 25, None).otherwise(F.lit(0.0)).alias("precipitation_mm"),
        _part(3000).alias("wind_speed_10m"),
        none(k == 99, 10 + _part(2000) + (dom * 5 + kind) % 4 * 8).alias("wind_gusts_10m"),
        k.cast("long").alias("weather_code"),
    )
    air = _stamped(
        e.where(F.col("event_type").isin("purchase", "signup") & (dom <= 25)), (-(e_id % 5)).cast("int"), F.col("valid_ts_utc"),
        none(e_id % 13 == 0, _part(3000) + (dom * 3 + kind * 7) % 5 * 10).alias("european_aqi"),
        none(e_id % 19 == 0, _part(500)).alias("pm2_5"),
        _part(800).alias("pm10"), _part(400).alias("no2"), _part(900).alias("o3"),
    )
    river = _stamped(
        e.where((F.col("event_type") == "error") & kind.isin(*RIVER_SITES)), week, F.col("date"),
        none(e_id % 11 == 0, 500 + F.col("c") / F.lit(100.0)).alias("river_discharge_m3s"),
    )
    seen = (
        F.col("date"), _part(1000).alias("temperature_2m_mean"), (_part(1000) + 5).alias("temperature_2m_max"), (_part(1000) - 5).alias("temperature_2m_min"),
        _part(700).alias("precipitation_sum_mm"), _part(2500).alias("wind_speed_10m_max"),
    )
    observed = _stamped(e.where((F.col("event_type") == "view") & (dom <= 24)), (6 + e_id % 7).cast("int"), *seen)
    projection = _stamped(
        e.where(F.col("event_type") == "signup"), (1 - dom).cast("int"), F.date_add("date", (e_id % 700).cast("int")).alias("date"),
        F.lit(PROJECTION.constants["model"]).alias("model"), (_part(1000) + 6).alias("temperature_2m_max"), (_part(1000) - 6).alias("temperature_2m_min"),
        _part(600).alias("precipitation_sum_mm"), _part(2700).alias("wind_speed_10m_max"),
    )
    return Raw(weather, air, river, observed, projection)


def normals_of(raw: Raw) -> DataFrame:
    """Monthly normals from the daily weather; every tenth site has none."""
    daily = daily_weather(latest_weather(raw.weather)).where(~F.col("city_id").endswith(str(NO_NORMAL)))
    return daily.groupBy("city_id", F.month("date").alias("month")).agg(q_round(F.avg("temperature_2m_max"), 2).alias("normal_temperature_2m_max"))


def sites_of(spark: SparkSession, sf_dir: str, n_sites: int = 10) -> DataFrame:
    """The site dimension as its file would hold it: flags are texts."""
    site = F.col("site")
    return events(spark, sf_dir, n_sites).select("site", "city_id", "kind").distinct().select(
        "city_id", F.concat(F.lit("Site "), site).alias("city_name"), F.lit("XX").alias("country_code"), (site * 1.5).cast("double").alias("latitude"),
        (site * 2.5 - 10).cast("double").alias("longitude"), F.lit("UTC").alias("timezone"), F.lit("Region").alias("region"),
        F.when(site == 3, "false").when(site == 4, "TRUE").otherwise("true").alias("active"),
        F.when(F.col("kind").isin(*RIVER_SITES), "True").when(F.col("kind") != 1, "false").alias("river_enabled"), site.cast("int").alias("display_order"),
    )


def payloads(raw: DataFrame, feed: Feed, most: int = 1000) -> DataFrame:
    """JSON payloads of parallel arrays for every (city_id, run), in order of time; a run of more than about
    `most` rows of a site lands in several, told apart by `part`."""
    time = F.date_format("valid_ts_utc", "yyyy-MM-dd'T'HH:mm") if feed.root == "hourly" else F.col("date").cast("string")
    row = F.struct(F.col(feed.time_column).alias("at"), "event_id", time.alias("time"), *(F.col(c).alias(p) for p, c, _ in feed.measures))
    key = ["city_id", "ingestion_run_id"]
    sizes = raw.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("parts"))
    cut = raw.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("event_id"), F.col("parts")))
    rows = cut.groupBy(*key, "part").agg(F.array_sort(F.collect_list(row)).alias("r"))
    arrays = F.struct(*(F.col("r")[n].alias(n) for n in ("time", *(p for p, _, _ in feed.measures))))
    return rows.select(*key, "part", F.to_json(F.struct(arrays.alias(feed.root)), {"ignoreNullFields": "false"}).alias("payload"))


def damaged(df: DataFrame) -> DataFrame:
    """Payloads of which some are no JSON and some have a short array, by site and day of the run."""
    day = F.substring("ingestion_run_id", -2, 2).cast("int")
    return df.withColumn(
        "payload",
        F.when((day % 5 == 0) & F.col("city_id").endswith("1"), "{").when(day % 5 == 1, F.regexp_replace("payload", r'"time":\[', '"time":["2024-01-01T00:00",')).otherwise(F.col("payload")),
    )


FEED_OF = {"payload_weather": ("weather", WEATHER), "payload_air": ("air", AIR), "payload_river": ("river", RIVER), "payload_observed": ("observed", OBSERVED), "payload_projection": ("projection", PROJECTION)}
