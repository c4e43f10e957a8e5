"""Baselines, next-day changes, factor scores and the driver: the score history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.config import ScoringConfig
from gaugeline.functions import clamp, null_greatest, q_round

FACTORS = ("heat_score", "wind_score", "rain_score", "air_score", "river_score")
CONTEXT = ("temperature_2m_max", "precipitation_sum_mm", "wind_gusts_10m_max", "european_aqi_max", "river_discharge_m3s")


def with_baseline(panel: DataFrame, normals: DataFrame) -> DataFrame:
    """Adds month and the site's normal of that month. Twelve rows a site: Spark broadcasts them while
    they are under its threshold and joins on the key beyond it."""
    base = normals.select("city_id", F.col("month").cast("int").alias("month"), "normal_temperature_2m_max")
    return panel.withColumn("month", F.month("date")).join(base, ["city_id", "month"], "left")


def changes(next_temperature: Column, next_river: Column) -> dict[str, Column]:
    """The changes to the next row's temperature and discharge, by name."""
    river = F.col("river_discharge_m3s")
    return {
        "temp_velocity": F.coalesce(next_temperature - F.col("temperature_2m_max"), F.lit(0.0)),
        "river_velocity_pct": F.when(river.isNotNull() & (river > 0), F.coalesce((next_river - river) / river, F.lit(0.0))).otherwise(0.0),
    }


def with_velocity(df: DataFrame) -> DataFrame:
    """Adds the change to the site's next row in temperature, and the relative one in discharge; 0 where unknown."""
    w = Window.partitionBy("city_id").orderBy("date")
    return df.withColumns(changes(F.lead("temperature_2m_max").over(w), F.lead("river_discharge_m3s").over(w)))


def with_velocity_in_blocks(df: DataFrame, days: int = 1000) -> DataFrame:
    """with_velocity for sites of very long histories: blocks of `days` calendar days are tasks of their own.

    A block's last row takes its next row from the first of the site's next block that has any, which is
    handed over in a table of a row a block. Rows are shuffled once, by site and block. df has one row a
    (city_id, date); `_block` and `_next` must not be columns."""
    key, values = ["city_id", "_block"], ("temperature_2m_max", "river_discharge_m3s")
    rows = df.withColumn("_block", F.floor(F.unix_date("date") / days)).repartition(*key)
    heads = rows.groupBy(*key).agg(F.min_by(F.struct(*values), "date").alias("head"))
    following = F.lead("head").over(Window.partitionBy("city_id").orderBy("_block"))
    heads = heads.select("city_id", "_block", following.alias("_next"))
    w = Window.partitionBy(*key).orderBy("date")
    last = F.lead("date").over(w).isNull()
    after = lambda c: F.when(last, F.col("_next")[c]).otherwise(F.lead(c).over(w))
    found = rows.join(heads, key)
    return found.withColumns(changes(*map(after, values))).drop("_block", "_next")


def with_factors(df: DataFrame, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Adds the five factor scores, unrounded; a null signal gives a null score."""
    up = lambda c: null_greatest(F.lit(0.0), c)
    held = lambda c: clamp(c, 0.0, cfg.top)
    heat = (F.col("temperature_2m_max") - F.col("normal_temperature_2m_max")) * cfg.anomaly + up(F.col("temp_velocity")) * cfg.warming
    return df.withColumns({
        "heat_score": held(heat),
        "wind_score": held(up(F.col("wind_gusts_10m_max") - cfg.gust_floor) * cfg.gust),
        "rain_score": held(F.col("precipitation_sum_mm") * cfg.rain),
        "air_score": held(F.coalesce("european_aqi_max", F.lit(0.0))),
        "river_score": held(up(F.col("river_velocity_pct")) * cfg.river),
    })


def with_overall(df: DataFrame, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Rounds the factors and adds the overall score, the largest unrounded factor, and its driver."""
    df = df.withColumn("global_tipping_score", q_round(null_greatest(*map(F.col, FACTORS)), cfg.digits))
    df = df.withColumns({c: q_round(F.col(c), cfg.digits) for c in FACTORS})
    overall = F.col("global_tipping_score")
    driver = reduce(lambda w, d: w.when(overall == F.col(d[0]), d[1]), cfg.drivers, F.when(overall == 0, cfg.calm)).otherwise(cfg.unknown)
    return df.withColumn("primary_driver", driver)


def scored(panel: DataFrame, normals: DataFrame, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """The panel with all scores and the driver; other columns stay."""
    return with_overall(with_factors(with_velocity(with_baseline(panel, normals)), cfg), cfg)


HISTORY = ("city_id", "date", *CONTEXT, *FACTORS, "global_tipping_score", "primary_driver")


def risk_history(panel: DataFrame, normals: DataFrame, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    return scored(panel, normals, cfg).select(*HISTORY)
