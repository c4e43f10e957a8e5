"""The five feeds as declarations: payload shape, renames, grain and the raw table's schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SITES = T.StructType([
    T.StructField("city_id", T.StringType(), False), T.StructField("city_name", T.StringType()), T.StructField("country_code", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("timezone", T.StringType()),
    T.StructField("region", T.StringType()), T.StructField("active", T.StringType()), T.StructField("river_enabled", T.StringType()),
    T.StructField("display_order", T.IntegerType()),
])
NORMALS = T.StructType([
    T.StructField("city_id", T.StringType(), False), T.StructField("month", T.IntegerType(), False),
    T.StructField("normal_temperature_2m_mean", T.DoubleType()), T.StructField("normal_temperature_2m_max", T.DoubleType()),
    T.StructField("normal_daily_precipitation_mm", T.DoubleType()), T.StructField("normal_wind_speed_10m_max", T.DoubleType()),
])


@dataclass(frozen=True)
class Feed:
    """measures are (payload name, column, type); the time column is hourly or daily."""

    name: str
    root: str
    measures: tuple[tuple[str, str, str], ...]
    constants: dict[str, str] = field(default_factory=dict)

    @property
    def time_column(self) -> str:
        return "valid_ts_utc" if self.root == "hourly" else "date"

    @property
    def columns(self) -> list[str]:
        return [*self.constants, *(c for _, c, _ in self.measures)]

    @property
    def payload_schema(self) -> str:
        arrays = ", ".join(f"{p}: array<{t}>" for p, _, t in self.measures)
        return f"{self.root} struct<time: array<string>, {arrays}>, _corrupt string"

    @property
    def raw_schema(self) -> T.StructType:
        """Required columns are not nullable; append_raw's checks enforce them."""
        time = T.TimestampNTZType() if self.root == "hourly" else T.DateType()
        kinds = {"double": T.DoubleType(), "bigint": T.LongType()}
        return T.StructType([
            T.StructField("ingestion_run_id", T.StringType(), False), T.StructField("ingested_at_utc", T.TimestampType(), False),
            T.StructField("city_id", T.StringType(), False), T.StructField(self.time_column, time, False),
            *(T.StructField(c, T.StringType(), False) for c in self.constants),
            *(T.StructField(c, kinds[t]) for _, c, t in self.measures),
        ])


#: Names in the payloads and in the tables.
WEATHER = Feed("weather", "hourly", (
    ("temperature_2m", "temperature_2m", "double"), ("precipitation", "precipitation_mm", "double"),
    ("wind_speed_10m", "wind_speed_10m", "double"), ("wind_gusts_10m", "wind_gusts_10m", "double"),
    ("weather_code", "weather_code", "bigint"),
))
AIR = Feed("air_quality", "hourly", (
    ("european_aqi", "european_aqi", "double"), ("pm2_5", "pm2_5", "double"), ("pm10", "pm10", "double"),
    ("nitrogen_dioxide", "no2", "double"), ("ozone", "o3", "double"),
))
RIVER = Feed("flood", "daily", (("river_discharge", "river_discharge_m3s", "double"),))
OBSERVED = Feed("historical", "daily", (
    ("temperature_2m_mean", "temperature_2m_mean", "double"), ("temperature_2m_max", "temperature_2m_max", "double"),
    ("temperature_2m_min", "temperature_2m_min", "double"), ("precipitation_sum", "precipitation_sum_mm", "double"),
    ("wind_speed_10m_max", "wind_speed_10m_max", "double"),
))
PROJECTION = Feed("climate", "daily", (
    ("temperature_2m_max", "temperature_2m_max", "double"), ("temperature_2m_min", "temperature_2m_min", "double"),
    ("precipitation_sum", "precipitation_sum_mm", "double"), ("wind_speed_10m_max", "wind_speed_10m_max", "double"),
), {"model": "MRI_AGCM3_2_S"})
FEEDS = (WEATHER, AIR, RIVER, OBSERVED, PROJECTION)
