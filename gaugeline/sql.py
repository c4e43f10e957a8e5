"""The models and their rules for users of SQL: temporary views, and scalar functions written in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (arguments, type, body); the same rules as gaugeline.functions has.
FUNCTIONS = {
    "q_round1": ("x DOUBLE", "DOUBLE", "CAST(round(CAST(x AS DECIMAL(28, 9)), 1) AS DOUBLE)"),
    "q_round2": ("x DOUBLE", "DOUBLE", "CAST(round(CAST(x AS DECIMAL(28, 9)), 2) AS DOUBLE)"),
    "q_round4": ("x DOUBLE", "DOUBLE", "CAST(round(CAST(x AS DECIMAL(28, 9)), 4) AS DOUBLE)"),
    "null_greatest": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END"),
    "null_least": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END"),
    "clamp": ("x DOUBLE, lo DOUBLE, hi DOUBLE", "DOUBLE", "CASE WHEN x IS NOT NULL THEN greatest(lo, least(hi, x)) END"),
    "flag": ("x STRING", "BOOLEAN", "coalesce(lower(x) = 'true', false)"),
}

#: The score history from the views signal_panel and normals.
RISK_HISTORY = """
WITH based AS (
  SELECT p.*, n.normal_temperature_2m_max FROM {signal_panel} p
  LEFT JOIN {normals} n ON n.city_id = p.city_id AND n.month = month(p.date)),
followed AS (
  SELECT *, lead(temperature_2m_max) OVER w AS next_temperature, lead(river_discharge_m3s) OVER w AS next_river
  FROM based WINDOW w AS (PARTITION BY city_id ORDER BY date)),
moved AS (
  SELECT *, coalesce(next_temperature - temperature_2m_max, 0) AS warming,
    CASE WHEN river_discharge_m3s > 0 THEN coalesce((next_river - river_discharge_m3s) / river_discharge_m3s, 0) ELSE 0 END AS rising
  FROM followed),
factors AS (
  SELECT city_id, date, temperature_2m_max, precipitation_sum_mm, wind_gusts_10m_max, european_aqi_max, river_discharge_m3s,
    clamp((temperature_2m_max - normal_temperature_2m_max) * 5 + null_greatest(0, warming) * 5, 0, 100) AS heat,
    clamp(null_greatest(0, wind_gusts_10m_max - 40) * 2.5D, 0, 100) AS wind,
    clamp(precipitation_sum_mm * 2, 0, 100) AS rain,
    clamp(coalesce(european_aqi_max, 0), 0, 100) AS air,
    clamp(null_greatest(0, rising) * 200, 0, 100) AS river
  FROM moved),
rounded AS (
  SELECT city_id, date, temperature_2m_max, precipitation_sum_mm, wind_gusts_10m_max, european_aqi_max, river_discharge_m3s,
    q_round1(heat) AS heat_score, q_round1(wind) AS wind_score, q_round1(rain) AS rain_score, q_round1(air) AS air_score, q_round1(river) AS river_score,
    q_round1(null_greatest(heat, null_greatest(wind, null_greatest(rain, null_greatest(air, river))))) AS global_tipping_score
  FROM factors)
SELECT *, CASE WHEN global_tipping_score = 0 THEN 'Stable' WHEN global_tipping_score = heat_score THEN 'Heat'
  WHEN global_tipping_score = river_score THEN 'River/Flood' WHEN global_tipping_score = wind_score THEN 'Wind'
  WHEN global_tipping_score = rain_score THEN 'Rain' WHEN global_tipping_score = air_score THEN 'Air Quality' ELSE 'Unknown' END AS primary_driver
FROM rounded
"""


def register(spark: SparkSession, models: dict[str, DataFrame], prefix: str = "") -> dict[str, str]:
    """Makes every model a temporary view, named with the prefix, and the functions known to the session; returns
    the views' names. Views are as lazy as the models."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    for name, df in models.items():
        df.createOrReplaceTempView(prefix + name)
    return {name: prefix + name for name in models}


def risk_history(spark: SparkSession, views: dict[str, str]) -> DataFrame:
    """The score history as plain SQL over the registered views (signal_panel and normals)."""
    return spark.sql(RISK_HISTORY.format(**views))
