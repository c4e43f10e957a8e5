"""Hand-built rows with results worked out by hand."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gaugeline.functions import clamp, null_greatest, null_least, q_round
from gaugeline.operators import current, scoring, staging

PANEL = "city_id string, date date, temperature_2m_max double, precipitation_sum_mm double, wind_gusts_10m_max double, european_aqi_max double, river_discharge_m3s double"
NORMALS = "city_id string, month int, normal_temperature_2m_max double"


def day(n):
    return date(2024, 1, n)


@pytest.fixture
def history(spark):
    def make(rows, normal=20.0):
        panel = spark.createDataFrame(rows, PANEL)
        base = spark.createDataFrame([("a", 1, normal)] if normal is not None else [], NORMALS)
        return {(r["city_id"], r["date"].day): r for r in scoring.risk_history(panel, base).collect()}

    return make


def one(history, temp=20.0, rain=0.0, gust=0.0, aqi=0.0, river=None, normal=20.0):
    return history([("a", day(1), temp, rain, gust, aqi, river)], normal)["a", 1]


def test_no_baseline_gives_unknown_and_stable_zone(history, spark):
    r = one(history, normal=None)
    assert (r["heat_score"], r["global_tipping_score"], r["primary_driver"]) == (None, None, "Unknown")
    zone = current.with_zone(spark.createDataFrame([("a", None)], "city_id string, current_tipping_score double")).first()
    assert zone["zone_order"] == 4


def test_null_temperature_gives_null_heat(history):
    assert one(history, temp=None)["heat_score"] is None


def test_last_row_has_no_velocity_and_gaps_use_the_next_row(history):
    rows = history([("a", day(1), 20.0, 0.0, 0.0, 0.0, 10.0), ("a", day(4), 22.0, 0.0, 0.0, 0.0, 15.0)])
    assert rows["a", 1]["heat_score"] == 10.0 and rows["a", 1]["river_score"] == 100.0
    assert rows["a", 4]["heat_score"] == 10.0 and rows["a", 4]["river_score"] == 0.0


@pytest.mark.parametrize(("today", "following", "score"), [(0.0, 10.0, 0.0), (10.0, None, 0.0), (20.0, 10.0, 0.0), (10.0, 11.0, 20.0), (None, 5.0, 0.0)])
def test_river(history, today, following, score):
    assert history([("a", day(1), 20.0, 0.0, 0.0, 0.0, today), ("a", day(2), 20.0, 0.0, 0.0, 0.0, following)])["a", 1]["river_score"] == score


def test_factors(history):
    assert one(history, rain=80.0)["rain_score"] == 100.0
    assert [one(history, gust=g)["wind_score"] for g in (40.0, 41.0)] == [0.0, 2.5]
    assert one(history, aqi=None)["air_score"] == 0.0
    r = one(history)
    assert (r["global_tipping_score"], r["primary_driver"]) == (0.0, "Stable")


def test_driver_precedence(history):
    assert one(history, rain=25.0, gust=60.0)["primary_driver"] == "Wind"
    rows = history([("a", day(1), 30.0, 0.0, 60.0, 0.0, 100.0), ("a", day(2), 20.0, 0.0, 0.0, 0.0, 125.0)])
    r = rows["a", 1]
    assert r["heat_score"] == r["wind_score"] == r["river_score"] == 50.0 and r["primary_driver"] == "Heat"


def test_zone_bounds(spark):
    df = spark.createDataFrame([(str(s), s) for s in (30.9, 31.0, 60.9, 61.0, 80.9, 81.0)], "city_id string, current_tipping_score double")
    assert [r["zone_order"] for r in current.with_zone(df).orderBy("current_tipping_score").collect()] == [4, 3, 3, 2, 2, 1]


HISTORY = "city_id string, date date, global_tipping_score double, primary_driver string"


@pytest.mark.parametrize("rank", ["window", "histogram"])
def test_current_window_ties_and_ranks(spark, rank):
    rows = [
        ("a", day(14), 99.0, "Heat"), ("a", day(15), 70.0, "Wind"), ("a", day(16), 70.0, "Rain"), ("a", day(17), 99.0, "Heat"),
        ("b", day(16), 70.0, "Rain"), ("c", day(15), 60.0, "Heat"), ("d", day(15), None, "Unknown"), ("e", day(15), None, "Unknown"),
    ]
    out = {r["city_id"]: tuple(r)[1:] for r in current.risk_current(spark.createDataFrame(rows, HISTORY), day(15), rank=rank).select("city_id", "current_tipping_score", "current_primary_driver", "rank").collect()}
    assert out == {"a": (70.0, "Wind", 1), "b": (70.0, "Rain", 1), "c": (60.0, "Heat", 3), "d": (None, None, 4), "e": (None, None, 4)}


def test_zone_summary_orders_and_caps_names(spark):
    rows = [("b", 90.0, "Wind", 1), ("a", 85.0, "Heat", 2), ("c", 10.0, None, 3)]
    df = spark.createDataFrame(rows, "city_id string, current_tipping_score double, current_primary_driver string, rank long")
    assert [tuple(r)[1:] for r in current.zone_summary(df).collect()] == [(2, "a, b", "Heat, Wind", False), (1, "c", None, False)]
    assert [tuple(r)[1:] for r in current.zone_summary(df, max_items=None).collect()] == [(2, "a, b", "Heat, Wind", False), (1, "c", None, False)]
    cut = current.zone_summary(df, max_items=1).collect()
    assert [(r["cities_in_zone"], r["names_cut"]) for r in cut] == [("a", True), ("c", False)]
    nameless = current.zone_summary(df.union(spark.createDataFrame([(None, 90.0, "Rain", 1)], df.schema)), max_items=2).first()
    assert (nameless["city_count"], nameless["cities_in_zone"], nameless["drivers_in_zone"]) == (2, "a, b", "Heat, Rain, Wind")


WEATHER = "ingestion_run_id string, ingested_at_utc timestamp, city_id string, valid_ts_utc timestamp_ntz, temperature_2m double, precipitation_mm double, wind_speed_10m double, wind_gusts_10m double, weather_code long"


def hour(h, t, rain=None, run=1):
    return (f"run{run}", datetime(2024, 1, run), "a", datetime(2024, 1, 1, h), t, rain, None, None, 3)


def test_latest_keeps_the_newer_row_and_its_nulls(spark):
    df = spark.createDataFrame([hour(0, 1.0), hour(0, None, run=2), hour(1, 5.0)], WEATHER)
    out = {r["valid_ts_utc"].hour: r["temperature_2m"] for r in staging.latest_weather(df).collect()}
    assert out == {0: None, 1: 5.0}
    assert staging.latest_weather(staging.latest_weather(df).repartition(3)).count() == 2


def test_daily_rollups(spark):
    df = spark.createDataFrame([hour(0, 1.0), hour(1, 1.01, 1.5)], WEATHER)
    r = staging.daily_weather(df).first()
    assert (r["temperature_2m_mean"], r["precipitation_sum_mm"], r["wind_gusts_10m_max"], r["hour_count"]) == (1.01, 1.5, 0.0, 2)
    air = "city_id string, valid_ts_utc timestamp_ntz, european_aqi double, pm2_5 double, pm10 double, no2 double, o3 double"
    df = spark.createDataFrame([("a", datetime(2024, 1, 1, h), v, None, None, None, None) for h, v in enumerate((None, 10.0, 20.0))], air)
    r = staging.daily_air(df).first()
    assert (r["european_aqi_mean"], r["european_aqi_max"], r["pm2_5_mean"]) == (10.0, 20.0, 0.0)


def test_expressions(spark):
    df = spark.createDataFrame([(1.005, None), (-3.0, 2.0), (250.0, 1.0)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    rows = df.select(q_round(x, 2), clamp(x, 0.0, 100.0), null_greatest(x, y), null_least(x, y), clamp(y, 0.0, 1.0)).collect()
    assert [tuple(r) for r in rows] == [(1.01, 1.005, None, None, None), (-3.0, 0.0, 2.0, -3.0, 1.0), (250.0, 100.0, 250.0, 1.0, 1.0)]


def test_empty_inputs(spark):
    weather = spark.createDataFrame([], WEATHER)
    daily = staging.daily_weather(staging.latest_weather(weather))
    assert daily.count() == 0 and "hour_count" in daily.columns
    assert scoring.risk_history(spark.createDataFrame([], PANEL), spark.createDataFrame([], NORMALS)).count() == 0
