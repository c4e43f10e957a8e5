"""SQL for every registered query of the engine, as a chain of named subqueries over the events table."""

from __future__ import annotations

PARTS = {
    "base": """SELECT event_id, event_type, CAST(ts AS TIMESTAMP) AS ts, user_id % 10 AS site, 'site_' || CAST(user_id % 10 AS VARCHAR) AS city_id,
      CAST(date_trunc('hour', ts) AS TIMESTAMP) AS valid_ts_utc, CAST(ts AS DATE) AS date, day(ts) AS dom,
      CAST(round(value * 100) AS BIGINT) AS c, (event_id * 37) % 100 AS k FROM events""",
    "raw_weather": """SELECT 'run_' || CAST(CAST(made_at AS DATE) AS VARCHAR) AS ingestion_run_id, made_at AS ingested_at_utc, city_id, valid_ts_utc,
      CASE WHEN event_id % 17 <> 0 THEN (c % 1000) / 100.0e0 + ((dom * 7 + site * 3) % 15) END AS temperature_2m,
      CASE WHEN k < 20 THEN (c % 1200) / 100.0e0 WHEN k < 25 THEN NULL ELSE 0.0e0 END AS precipitation_mm,
      (c % 3000) / 100.0e0 AS wind_speed_10m,
      CASE WHEN k <> 99 THEN 10 + (c % 2000) / 100.0e0 + ((dom * 5 + site) % 4) * 8 END AS wind_gusts_10m,
      CAST(k AS BIGINT) AS weather_code, event_id
      FROM (SELECT *, ts - to_days(CAST(event_id % 7 AS INTEGER)) AS made_at FROM base WHERE event_type IN ('click', 'view', 'error'))""",
    "raw_air": """SELECT 'run_' || CAST(CAST(made_at AS DATE) AS VARCHAR) AS ingestion_run_id, made_at AS ingested_at_utc, city_id, valid_ts_utc,
      CASE WHEN event_id % 13 <> 0 THEN (c % 3000) / 100.0e0 + ((dom * 3 + site * 7) % 5) * 10 END AS european_aqi,
      CASE WHEN event_id % 19 <> 0 THEN (c % 500) / 100.0e0 END AS pm2_5,
      (c % 800) / 100.0e0 AS pm10, (c % 400) / 100.0e0 AS no2, (c % 900) / 100.0e0 AS o3, event_id
      FROM (SELECT *, ts - to_days(CAST(event_id % 5 AS INTEGER)) AS made_at FROM base WHERE event_type IN ('purchase', 'signup') AND dom <= 25)""",
    "raw_river": """SELECT 'run_' || CAST(CAST(made_at AS DATE) AS VARCHAR) AS ingestion_run_id, made_at AS ingested_at_utc, city_id, date,
      CASE WHEN event_id % 11 <> 0 THEN 500 + c / 100.0e0 END AS river_discharge_m3s, event_id
      FROM (SELECT *, ts - to_days(CAST(event_id % 7 AS INTEGER)) AS made_at FROM base WHERE event_type = 'error' AND site IN (0, 5, 7))""",
    "raw_observed": """SELECT 'run_' || CAST(CAST(made_at AS DATE) AS VARCHAR) AS ingestion_run_id, made_at AS ingested_at_utc, city_id, date,
      (c % 1000) / 100.0e0 AS temperature_2m_mean, (c % 1000) / 100.0e0 + 5 AS temperature_2m_max, (c % 1000) / 100.0e0 - 5 AS temperature_2m_min,
      (c % 700) / 100.0e0 AS precipitation_sum_mm, (c % 2500) / 100.0e0 AS wind_speed_10m_max, event_id
      FROM (SELECT *, ts + to_days(CAST(6 + event_id % 7 AS INTEGER)) AS made_at FROM base WHERE event_type = 'view' AND dom <= 24)""",
    "raw_projection": """SELECT 'run_' || CAST(CAST(ts - to_days(CAST(dom - 1 AS INTEGER)) AS DATE) AS VARCHAR) AS ingestion_run_id, city_id,
      date + CAST(event_id % 700 AS INTEGER) AS date, 'MRI_AGCM3_2_S' AS model,
      (c % 1000) / 100.0e0 + 6 AS temperature_2m_max, (c % 1000) / 100.0e0 - 6 AS temperature_2m_min,
      (c % 600) / 100.0e0 AS precipitation_sum_mm, (c % 2700) / 100.0e0 AS wind_speed_10m_max, event_id
      FROM base WHERE event_type = 'signup'""",
    "latest_weather": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY city_id, valid_ts_utc ORDER BY ingested_at_utc DESC, event_id DESC) AS rn FROM raw_weather) WHERE rn = 1""",
    "latest_air": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY city_id, valid_ts_utc ORDER BY ingested_at_utc DESC, event_id DESC) AS rn FROM raw_air) WHERE rn = 1""",
    "latest_river": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY city_id, date ORDER BY ingested_at_utc DESC, event_id DESC) AS rn FROM raw_river) WHERE rn = 1""",
    "latest_observed": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY city_id, date ORDER BY ingested_at_utc DESC, event_id DESC) AS rn FROM raw_observed) WHERE rn = 1""",
    "daily_weather": """SELECT city_id, CAST(valid_ts_utc AS DATE) AS date, {r2(avg(temperature_2m))} AS temperature_2m_mean,
      {r2(max(temperature_2m))} AS temperature_2m_max, {r2(min(temperature_2m))} AS temperature_2m_min,
      {r2(sum(coalesce(precipitation_mm, 0)))} AS precipitation_sum_mm, {r2(max(coalesce(wind_speed_10m, 0)))} AS wind_speed_10m_max,
      {r2(max(coalesce(wind_gusts_10m, 0)))} AS wind_gusts_10m_max, max(weather_code) AS weather_code_max, count(*) AS hour_count
      FROM latest_weather GROUP BY 1, 2""",
    "daily_air": """SELECT city_id, CAST(valid_ts_utc AS DATE) AS date, {r2(avg(coalesce(european_aqi, 0)))} AS european_aqi_mean,
      max(european_aqi) AS european_aqi_max, {r2(avg(coalesce(pm2_5, 0)))} AS pm2_5_mean, {r2(avg(coalesce(pm10, 0)))} AS pm10_mean,
      {r2(avg(coalesce(no2, 0)))} AS no2_mean, {r2(avg(coalesce(o3, 0)))} AS o3_mean, count(*) AS hour_count
      FROM latest_air GROUP BY 1, 2""",
    "signal_panel": """SELECT w.* EXCLUDE (hour_count), a.european_aqi_mean, a.european_aqi_max, a.pm2_5_mean, a.pm10_mean, a.no2_mean, a.o3_mean,
      f.river_discharge_m3s, h.temperature_2m_mean AS hist_temperature_2m_mean, h.temperature_2m_max AS hist_temperature_2m_max,
      h.temperature_2m_min AS hist_temperature_2m_min, h.precipitation_sum_mm AS hist_precipitation_sum_mm, h.wind_speed_10m_max AS hist_wind_speed_10m_max
      FROM daily_weather w LEFT JOIN daily_air a ON a.city_id = w.city_id AND a.date = w.date
      LEFT JOIN latest_river f ON f.city_id = w.city_id AND f.date = w.date
      LEFT JOIN latest_observed h ON h.city_id = w.city_id AND h.date = w.date""",
    "normals": """SELECT city_id, month(date) AS month, {r2(avg(temperature_2m_max))} AS normal_temperature_2m_max FROM daily_weather WHERE city_id <> 'site_9' GROUP BY 1, 2""",
    "baseline_join": """SELECT s.*, month(s.date) AS month, n.normal_temperature_2m_max FROM signal_panel s
      LEFT JOIN normals n ON n.city_id = s.city_id AND n.month = month(s.date)""",
    "in_turn": """SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY date) AS nth FROM baseline_join""",
    "velocity": """SELECT a.* EXCLUDE (nth), coalesce(b.temperature_2m_max - a.temperature_2m_max, 0) AS temp_velocity,
      CASE WHEN a.river_discharge_m3s > 0 AND b.river_discharge_m3s IS NOT NULL THEN (b.river_discharge_m3s - a.river_discharge_m3s) / a.river_discharge_m3s ELSE 0.0e0 END AS river_velocity_pct
      FROM in_turn a LEFT JOIN in_turn b ON b.city_id = a.city_id AND b.nth = a.nth + 1""",
    "factor_rows": """SELECT city_id, date, 'heat_score' AS factor, {held((temperature_2m_max - normal_temperature_2m_max) * 5.0e0 + greatest(0, temp_velocity) * 5.0e0)} AS score FROM velocity
      UNION ALL SELECT city_id, date, 'wind_score', {held((wind_gusts_10m_max - 40) * 2.5e0)} FROM velocity
      UNION ALL SELECT city_id, date, 'rain_score', {held(precipitation_sum_mm * 2.0e0)} FROM velocity
      UNION ALL SELECT city_id, date, 'air_score', {held(coalesce(european_aqi_max, 0.0e0))} FROM velocity
      UNION ALL SELECT city_id, date, 'river_score', {held(river_velocity_pct * 200.0e0)} FROM velocity""",
    # fixed values: which driver names a day when several factors are the largest, first to last
    "drivers": """SELECT * FROM (VALUES (1, 'heat_score', 'Heat'), (2, 'river_score', 'River/Flood'), (3, 'wind_score', 'Wind'), (4, 'rain_score', 'Rain'), (5, 'air_score', 'Air Quality')) d(place, factor, driver)""",
    "overall": """SELECT city_id, date, CASE WHEN count(score) = 5 THEN {r1(max(score))} END AS global_tipping_score FROM factor_rows GROUP BY city_id, date""",
    "first_driver": """SELECT o.city_id, o.date, arg_min(d.driver, d.place) AS driver FROM overall o
      JOIN factor_rows f ON f.city_id = o.city_id AND f.date = o.date AND {r1(f.score)} = o.global_tipping_score JOIN drivers d ON d.factor = f.factor GROUP BY 1, 2""",
    "factor_scores": """PIVOT factor_rows ON factor IN ('heat_score', 'wind_score', 'rain_score', 'air_score', 'river_score') USING max(score) GROUP BY city_id, date""",
    "risk_history": """SELECT v.city_id, v.date, v.temperature_2m_max, v.precipitation_sum_mm, v.wind_gusts_10m_max, v.european_aqi_max, v.river_discharge_m3s,
      {r1(s.heat_score)} AS heat_score, {r1(s.wind_score)} AS wind_score, {r1(s.rain_score)} AS rain_score, {r1(s.air_score)} AS air_score, {r1(s.river_score)} AS river_score,
      o.global_tipping_score, if(o.global_tipping_score = 0, 'Stable', coalesce(l.driver, 'Unknown')) AS primary_driver
      FROM velocity v JOIN factor_scores s ON s.city_id = v.city_id AND s.date = v.date JOIN overall o ON o.city_id = v.city_id AND o.date = v.date
      LEFT JOIN first_driver l ON l.city_id = v.city_id AND l.date = v.date""",
    "window_rows": """SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY global_tipping_score DESC NULLS LAST, date, primary_driver) AS rn
      FROM risk_history WHERE date BETWEEN DATE '2024-01-15' AND DATE '2024-01-16'""",
    "risk_current": """SELECT *, rank() OVER (ORDER BY current_tipping_score DESC NULLS LAST) AS rank FROM (
      SELECT city_id, max(global_tipping_score) AS current_tipping_score,
      max(CASE WHEN rn = 1 AND global_tipping_score IS NOT NULL THEN primary_driver END) AS current_primary_driver FROM window_rows GROUP BY city_id)""",
    # fixed values: zones and the least score of each
    "zones": """SELECT CAST(zone_order AS BIGINT) AS zone_order, least, zone_name FROM (VALUES (1, 81, '🔴 Critical'), (2, 61, '🟠 Tipping'), (3, 31, '🟡 Monitoring'), (4, NULL, '🟢 Stable')) z(zone_order, least, zone_name)""",
    "zoned": """SELECT r.*, z.zone_name, z.zone_order FROM risk_current r JOIN zones z ON z.least IS NULL OR r.current_tipping_score >= z.least
      QUALIFY row_number() OVER (PARTITION BY r.city_id ORDER BY z.zone_order) = 1""",
    "zone_summary": """SELECT zone_name, count(city_id) AS city_count, string_agg(city_id, ', ' ORDER BY city_id) AS cities_in_zone,
      string_agg(DISTINCT current_primary_driver, ', ' ORDER BY current_primary_driver) AS drivers_in_zone, count(city_id) > 1000 AS names_cut FROM zoned GROUP BY zone_name, zone_order""",
    "sites": """SELECT DISTINCT city_id, 'Site ' || CAST(site AS VARCHAR) AS city_name, 'XX' AS country_code, CAST(site * 1.5 AS DOUBLE) AS latitude,
      CAST(site * 2.5 - 10 AS DOUBLE) AS longitude, 'UTC' AS timezone, 'Region' AS region, CASE WHEN site = 3 THEN 'false' WHEN site = 4 THEN 'TRUE' ELSE 'true' END AS active,
      CASE WHEN site IN (0, 5, 7) THEN 'True' WHEN site <> 1 THEN 'false' END AS river_enabled, CAST(site AS BIGINT) AS display_order FROM base""",
    "sites_active": """SELECT * REPLACE (coalesce(lower(river_enabled) = 'true', false) AS river_enabled) FROM sites WHERE lower(active) = 'true'""",
    "landed": """SELECT *, CASE WHEN CAST(right(ingestion_run_id, 2) AS INTEGER) % 5 = 0 AND right(city_id, 1) = '1' THEN 'corrupt_json'
      WHEN CAST(right(ingestion_run_id, 2) AS INTEGER) % 5 = 1 THEN 'short_array' END AS reason FROM raw_weather""",
    "payload_errors": """SELECT DISTINCT city_id, ingestion_run_id, 'weather' AS feed, reason FROM landed WHERE reason IS NOT NULL""",
    "days": """SELECT CAST(range AS DATE) AS date FROM range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)""",
    "loaded": """SELECT city_id, 'weather' AS feed, CAST(valid_ts_utc AS DATE) AS date FROM raw_weather UNION SELECT city_id, 'air_quality', CAST(valid_ts_utc AS DATE) FROM raw_air
      UNION SELECT city_id, 'flood', date FROM raw_river UNION SELECT city_id, 'historical', date FROM raw_observed""",
}

#: One pass for every not_null check, one for every unique check.
NOT_NULL = (
    *((m, c) for m in ("latest_weather", "latest_air") for c in ("city_id", "valid_ts_utc")),
    *((m, c) for m in ("latest_river", "latest_observed", "daily_weather", "daily_air", "signal_panel") for c in ("city_id", "date")),
    ("risk_history", "city_id"), ("risk_history", "date"), ("risk_history", "global_tipping_score"),
    ("risk_current", "city_id"), ("risk_current", "current_tipping_score"), ("zone_summary", "zone_name"),
)
UNIQUE = (("risk_current", "city_id"), ("zone_summary", "zone_name"))

FINAL = {
    **{m: f"SELECT * FROM {m}" for m in ("latest_weather", "latest_air", "latest_river", "latest_observed", "daily_weather", "daily_air", "signal_panel", "risk_history", "risk_current", "zone_summary", "payload_errors", "sites_active")},
    "baseline_join": "SELECT city_id, date, month, temperature_2m_max, normal_temperature_2m_max FROM baseline_join",
    "velocity": "SELECT city_id, date, temp_velocity, river_velocity_pct FROM velocity",
    "factor_scores": "SELECT city_id, date, heat_score, wind_score, rain_score, air_score, river_score FROM factor_scores",
    "risk_rank_histogram": "SELECT * FROM risk_current",
    "ranking": "SELECT * FROM risk_current",
    "trend": "SELECT city_id, date, global_tipping_score FROM risk_history",
    "factor_unpivot": " UNION ALL ".join(f"SELECT city_id, date, '{f}' AS factor, {f} AS score FROM risk_history" for f in ("heat_score", "wind_score", "rain_score", "air_score", "river_score")),
    "site_map": "SELECT c.*, s.city_name, s.latitude, s.longitude FROM risk_current c JOIN sites s ON s.city_id = c.city_id",
    "zone_counts": "SELECT zone_name, zone_order, count(city_id) AS city_count FROM zoned GROUP BY 1, 2",
    "quality_report": " UNION ALL ".join(
        [f"SELECT '{m}' AS model, '{c}' AS \"column\", 'not_null' AS \"check\", count(*) FILTER (WHERE {c} IS NULL) AS violations, count(*) FILTER (WHERE {c} IS NULL) = 0 AS passed FROM {m}" for m, c in NOT_NULL]
        + [f"SELECT '{m}', '{c}', 'unique', count(*), count(*) = 0 FROM (SELECT {c} FROM {m} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)" for m, c in UNIQUE]
    ),
    "completeness": "SELECT city_id, date, hour_count FROM daily_weather WHERE hour_count < 24",
    "run_summary": """SELECT *, CASE WHEN errors = 0 THEN 'success' WHEN weather + air_quality + flood + historical + climate > 0 THEN 'partial_failure' ELSE 'failure' END AS status
      FROM (SELECT ingestion_run_id, count(*) FILTER (WHERE feed = 'weather') AS weather, count(*) FILTER (WHERE feed = 'air_quality') AS air_quality,
      count(*) FILTER (WHERE feed = 'flood') AS flood, count(*) FILTER (WHERE feed = 'historical') AS historical, count(*) FILTER (WHERE feed = 'climate') AS climate,
      count(*) FILTER (WHERE feed = 'errors') AS errors FROM (
      SELECT ingestion_run_id, 'weather' AS feed FROM landed WHERE reason IS NULL UNION ALL SELECT ingestion_run_id, 'air_quality' FROM raw_air
      UNION ALL SELECT ingestion_run_id, 'flood' FROM raw_river UNION ALL SELECT ingestion_run_id, 'historical' FROM raw_observed
      UNION ALL SELECT ingestion_run_id, 'climate' FROM raw_projection UNION ALL SELECT ingestion_run_id, 'errors' FROM payload_errors) GROUP BY ingestion_run_id)""",
    "payload_weather": "SELECT city_id, ingestion_run_id, valid_ts_utc, temperature_2m, precipitation_mm, wind_speed_10m, wind_gusts_10m, weather_code FROM raw_weather",
    "payload_air": "SELECT city_id, ingestion_run_id, valid_ts_utc, european_aqi, pm2_5, pm10, no2, o3 FROM raw_air",
    "payload_river": "SELECT city_id, ingestion_run_id, date, river_discharge_m3s FROM raw_river",
    "payload_observed": "SELECT city_id, ingestion_run_id, date, temperature_2m_mean, temperature_2m_max, temperature_2m_min, precipitation_sum_mm, wind_speed_10m_max FROM raw_observed",
    "payload_projection": "SELECT * EXCLUDE (event_id) FROM raw_projection",
    "run_windows": """SELECT x.feed, d.date AS run_date, d.date + x.a AS start_date, d.date + x.b AS end_date
      FROM (SELECT DISTINCT date FROM base) d, (VALUES ('weather', 0, 6), ('air_quality', 0, 4), ('flood', 0, 6), ('historical', -12, -6)) x(feed, a, b)
      UNION ALL SELECT 'climate', date, date, CAST(date_trunc('month', date) + INTERVAL 10 YEAR AS DATE) FROM (SELECT DISTINCT date FROM base) WHERE day(date) = 1""",
    "climatology": """SELECT city_id, month(date) AS month, {r2(avg(temperature_2m_mean))} AS normal_temperature_2m_mean, {r2(avg(temperature_2m_max))} AS normal_temperature_2m_max,
      {r2(avg(precipitation_sum_mm))} AS normal_daily_precipitation_mm, {r2(avg(wind_speed_10m_max))} AS normal_wind_speed_10m_max FROM latest_observed GROUP BY 1, 2""",
    "forecast_deviation": """SELECT lead_days, count(*) AS days, {r4(avg(gap))} AS mean_error, {r4(avg(abs(gap)))} AS mean_abs_error FROM (
      SELECT f.lead_days, f.forecast - o.temperature_2m_mean AS gap FROM (
      SELECT city_id, CAST(valid_ts_utc AS DATE) AS date, CAST(valid_ts_utc AS DATE) - CAST(ingested_at_utc AS DATE) AS lead_days, {r4(avg(temperature_2m))} AS forecast
      FROM raw_weather GROUP BY 1, 2, 3) f JOIN latest_observed o ON o.city_id = f.city_id AND o.date = f.date) WHERE gap IS NOT NULL GROUP BY 1""",
    "projection_deviation": """SELECT p.*, n.normal_temperature_2m_max, {r4(projected - normal_temperature_2m_max)} AS deviation FROM (
      SELECT city_id, model, year(date) AS year, month(date) AS month, {r4(avg(temperature_2m_max))} AS projected FROM raw_projection GROUP BY 1, 2, 3, 4) p
      JOIN normals n ON n.city_id = p.city_id AND n.month = p.month""",
    "coverage_gaps": """SELECT s.city_id, f.feed, d.date FROM sites_active s, (VALUES ('weather'), ('air_quality'), ('flood'), ('historical')) f(feed), days d
      WHERE (f.feed <> 'flood' OR s.river_enabled) AND NOT EXISTS (SELECT 1 FROM loaded l WHERE l.city_id = s.city_id AND l.feed = f.feed AND l.date = d.date)""",
    "history_incremental": "SELECT * FROM risk_history",
    "history_published": "SELECT * FROM risk_history",
    "raw_appended": "SELECT * EXCLUDE (event_id), CAST(valid_ts_utc AS DATE) AS _day FROM raw_weather",
    "raw_replayed": "SELECT * EXCLUDE (event_id), CAST(valid_ts_utc AS DATE) AS _day FROM raw_weather",
    "history_by_runs": "SELECT * FROM risk_history",
    "history_stream": "SELECT * FROM risk_history",
    "velocity_blocks": "SELECT city_id, date, temp_velocity, river_velocity_pct FROM velocity",
    "panel_bucketed": "SELECT * FROM signal_panel",
    "landed_files": """SELECT ingestion_run_id, city_id, coalesce(reason, 'good') AS reason, count(*) FILTER (WHERE reason IS NULL) AS rows FROM (
      SELECT ingestion_run_id, city_id, CASE WHEN right(city_id, 1) = '2' AND CAST(right(ingestion_run_id, 2) AS INTEGER) % 7 = 0 THEN 'too_large' ELSE reason END AS reason FROM landed) GROUP BY 1, 2, 3""",
    "risk_history_sql": "SELECT * FROM risk_history",
    "raw_required": """SELECT *, CASE WHEN city_id IS NULL OR valid_ts_utc IS NULL THEN 'missing_required' END AS reason FROM (
      SELECT event_id, CASE WHEN event_id % 23 <> 0 THEN city_id END AS city_id, CASE WHEN event_id % 29 <> 0 THEN valid_ts_utc END AS valid_ts_utc FROM raw_weather)""",
    "raw_stamped": "SELECT city_id, count(*) AS n, CAST(1 AS BIGINT) AS runs, CAST(1 AS BIGINT) AS times, true AS named_by_time FROM raw_weather GROUP BY city_id",
    "sites_file": "SELECT * FROM sites_active",
    "normals_file": """SELECT city_id, month(date) AS month, {r2(avg(temperature_2m_mean))} AS normal_temperature_2m_mean, {r2(avg(temperature_2m_max))} AS normal_temperature_2m_max,
      {r2(avg(precipitation_sum_mm))} AS normal_daily_precipitation_mm, {r2(avg(wind_speed_10m_max))} AS normal_wind_speed_10m_max FROM latest_observed GROUP BY 1, 2""",
    "climatology_merged": """SELECT city_id, month(date) AS month, {r2(avg(temperature_2m_mean))} AS normal_temperature_2m_mean, {r2(avg(temperature_2m_max))} AS normal_temperature_2m_max,
      {r2(avg(precipitation_sum_mm))} AS normal_daily_precipitation_mm, {r2(avg(wind_speed_10m_max))} AS normal_wind_speed_10m_max FROM latest_observed GROUP BY 1, 2""",
    "risk_today": "SELECT * FROM risk_current",
    "latest_stream": "SELECT * FROM latest_weather",
}


FINAL["quality_lazy"] = FINAL["quality_report"]


def expand(sql: str) -> str:
    """Writes out {r1(x)}, {r2(x)}, {r4(x)}: x rounded by way of a decimal, and {held(x)}: x held within 0 and 100, null staying null."""
    out, at = "", 0
    while (a := sql.find("{", at)) >= 0:
        b = sql.index("}", a)
        name, _, arg = sql[a + 1 : b - 1].partition("(")
        if name == "held":
            made = f"(CASE WHEN ({arg}) IS NOT NULL THEN greatest(0.0e0, least(100.0e0, {arg})) END)"
        else:
            made = f"CAST(round(CAST(({arg}) AS DECIMAL(28, 9)), {name[1:]}) AS DOUBLE)"
        out, at = out + sql[at:a] + made, b + 1
    return out + sql[at:]


#: Queries over 1,500 sites instead of ten: a site's last digit is what it was there.
MANY = {
    "risk_rank_range": ("SELECT * FROM risk_current", 6),
    "zone_members": ("""SELECT zone_name, zone_order, nth // 100 AS chunk, string_agg(city_id, ', ' ORDER BY city_id) AS cities
      FROM (SELECT *, row_number() OVER (PARTITION BY zone_order ORDER BY city_id) - 1 AS nth FROM zoned) GROUP BY 1, 2, 3""", 1),
}


def of_many(sql: str, digits: int) -> str:
    """A part of the chain for 1,500 sites, with scores of so many digits."""
    sql = sql.replace("user_id % 10 AS site", "user_id % 1500 % 10 AS site").replace("CAST(user_id % 10 AS VARCHAR)", "CAST(user_id % 1500 AS VARCHAR)")
    return sql.replace("city_id <> 'site_9'", "right(city_id, 1) <> '9'").replace("{r1(", f"{{r{digits}(")


def oracle_sql() -> dict[str, str]:
    chain = ",\n".join(f"{name} AS ({expand(sql)})" for name, sql in PARTS.items())
    many = {name: ",\n".join(f"{part} AS ({expand(of_many(sql, digits))})" for part, sql in PARTS.items()) for name, (_, digits) in MANY.items()}
    return {name: f"WITH {chain}\n{expand(sql)}" for name, sql in FINAL.items()} | {name: f"WITH {many[name]}\n{sql}" for name, (sql, _) in MANY.items()}
