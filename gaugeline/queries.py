"""The registered queries of the engine over the adapter's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline import fixtures, plans, sql
from gaugeline.config import ScoringConfig
from gaugeline.operators import analysis, current, quality, scoring, staging
from gaugeline.shared import shared_folder
from gaugeline.sources import files, landing
from gaugeline.sources.feeds import AIR, NORMALS, OBSERVED, RIVER, SITES, WEATHER
from gaugeline.sources.files import active_sites
from gaugeline.sources.payloads import parse_payload
from gaugeline.streaming import read_latest, stream_history, stream_latest

AS_OF = date(2024, 1, 15)
MANY = 1500
Query = Callable[[SparkSession, str], DataFrame]


def models(spark: SparkSession, sf_dir: str, n_sites: int = 10) -> dict[str, DataFrame]:
    raw = fixtures.raw_tables(spark, sf_dir, n_sites)
    return plans.build(raw.weather, raw.air, raw.river, raw.observed, fixtures.normals_of(raw), AS_OF)


def plain(df: DataFrame) -> DataFrame:
    """Types that every engine has alike: long integers and timestamps without a zone."""
    to = {"timestamp": "timestamp_ntz", "int": "bigint"}
    return df.select(*(F.col(n).cast(to[t]).alias(n) if t in to else F.col(n) for n, t in df.dtypes))


def _model(name: str) -> Query:
    return lambda spark, sf_dir: plain(models(spark, sf_dir)[name])


def baseline_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.raw_tables(spark, sf_dir)
    df = scoring.with_baseline(models(spark, sf_dir)["signal_panel"], fixtures.normals_of(raw))
    return plain(df.select("city_id", "date", "month", "temperature_2m_max", "normal_temperature_2m_max"))


def _velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.raw_tables(spark, sf_dir)
    return scoring.with_velocity(scoring.with_baseline(models(spark, sf_dir)["signal_panel"], fixtures.normals_of(raw)))


def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _velocity(spark, sf_dir).select("city_id", "date", "temp_velocity", "river_velocity_pct")


def factor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_factors(_velocity(spark, sf_dir)).select("city_id", "date", *scoring.FACTORS)


def risk_rank_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current.risk_current(models(spark, sf_dir)["risk_history"], AS_OF, rank="histogram")


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current.ranking(models(spark, sf_dir)["risk_current"])


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current.trend(models(spark, sf_dir)["risk_history"])


def factor_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current.factor_long(models(spark, sf_dir)["risk_history"])


def site_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current.site_map(models(spark, sf_dir)["risk_current"], fixtures.sites_of(spark, sf_dir))


def zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current.zone_counts(models(spark, sf_dir)["risk_current"])


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of models that are stored, made while they are written."""
    raw = fixtures.raw_tables(spark, sf_dir)
    return plans.store_models(spark, _place(spark, "models"), raw.weather, raw.air, raw.river, raw.observed, fixtures.normals_of(raw), AS_OF)[1]


def quality_lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same checks of models that are not stored."""
    return quality.run_checks(models(spark, sf_dir))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.incomplete_days(models(spark, sf_dir)["daily_weather"])


def _parsed_weather(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, errors = parse_payload(fixtures.damaged(fixtures.payloads(fixtures.raw_tables(spark, sf_dir).weather, WEATHER)), WEATHER)
    return rows, errors.drop("part").distinct()


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.raw_tables(spark, sf_dir)
    rows, errors = _parsed_weather(spark, sf_dir)
    return quality.run_summary({"weather": rows, "air_quality": raw.air, "flood": raw.river, "historical": raw.observed, "climate": raw.projection}, errors)


def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed_weather(spark, sf_dir)[1]


def _payload(name: str) -> Query:
    table, feed = fixtures.FEED_OF[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = getattr(fixtures.raw_tables(spark, sf_dir), table)
        return parse_payload(fixtures.payloads(raw, feed), feed)[0].drop("payload_pos", "part")

    return run


def sites_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(active_sites(fixtures.sites_of(spark, sf_dir)))


def run_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.run_windows(fixtures.events(spark, sf_dir).select(F.col("date").alias("run_date")).distinct())


def climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(analysis.climatology(models(spark, sf_dir)["latest_observed"]))


def forecast_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.forecast_deviation(fixtures.raw_tables(spark, sf_dir).weather, models(spark, sf_dir)["latest_observed"])


def projection_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.raw_tables(spark, sf_dir)
    return plain(analysis.projection_deviation(raw.projection, fixtures.normals_of(raw)))


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.raw_tables(spark, sf_dir)
    feeds = {"weather": raw.weather.withColumn("date", F.to_date("valid_ts_utc")), "air_quality": raw.air.withColumn("date", F.to_date("valid_ts_utc")), "flood": raw.river, "historical": raw.observed}
    parts = [df.select("city_id", F.lit(f).alias("feed"), "date") for f, df in feeds.items()]
    loaded = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()
    return analysis.coverage_gaps(active_sites(fixtures.sites_of(spark, sf_dir)), tuple(feeds), loaded, date(2024, 1, 1), date(2024, 1, 30))


def _old_and_changed(raw: fixtures.Raw) -> tuple[tuple[DataFrame, ...], tuple[DataFrame, ...], DataFrame]:
    """All feeds, those without a tenth of the rows, and the (city_id, date) of that tenth."""
    feeds, old = (raw.weather, raw.air, raw.river, raw.observed), F.col("event_id") % 10 != 0
    keys = [f.where(~old).select("city_id", (F.to_date("valid_ts_utc") if "valid_ts_utc" in f.columns else F.col("date")).alias("date")) for f in feeds]
    return feeds, tuple(f.where(old) for f in feeds), keys[0].union(keys[1]).union(keys[2]).union(keys[3]).distinct()


def history_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of nine tenths of the rows, refreshed with the rest: equal to risk_history."""
    raw = fixtures.raw_tables(spark, sf_dir)
    normals, (feeds, before, changed) = fixtures.normals_of(raw), _old_and_changed(raw)
    return plans.refresh_history(scoring.risk_history(plans.panel_of(*before), normals), feeds, changed, normals)


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def history_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of a published table, of which only the changed dates are written again."""
    at, raw = _place(spark, "published"), fixtures.raw_tables(spark, sf_dir)
    normals, (feeds, before, changed) = fixtures.normals_of(raw), _old_and_changed(raw)
    files.publish(scoring.risk_history(plans.panel_of(*before), normals), at)
    plans.refresh_published(spark, at, feeds, changed, normals)
    return spark.read.parquet(at)


def raw_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw weather, appended by two runs and read back by day."""
    at, raw = _place(spark, "raw"), fixtures.raw_tables(spark, sf_dir).weather
    for k in (0, 1):
        files.append_raw(raw.where(F.col("event_id") % 2 == k), at, WEATHER)
    return plain(files.read_raw(spark, at, WEATHER))


def raw_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by two runs of which one fails midway and is tried again, and both are replayed."""
    at, raw = _place(spark, "raw"), fixtures.raw_tables(spark, sf_dir).weather
    one, two = (raw.where(F.col("event_id") % 2 == k) for k in (0, 1))
    files.append_raw(one, at, WEATHER, "run-1")
    files.write_run(two.where(F.col("event_id") % 3 == 0), at, WEATHER, "run-2")  # ends before it is committed
    for rows, run in ((two, "run-2"), (two, "run-2"), (one.unionAll(two), "run-1")):
        files.append_raw(rows, at, WEATHER, run)
    return plain(files.read_raw(spark, at, WEATHER))


def history_by_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of stored raw tables, built after a first run and brought up to the second by its rows alone."""
    top, raw = _place(spark, "runs"), fixtures.raw_tables(spark, sf_dir)
    at = {f.name: f"{top}/{f.name}" for f in (WEATHER, AIR, RIVER, OBSERVED)}
    for run, mine in (("run-1", F.col("event_id") % 10 != 0), ("run-2", F.col("event_id") % 10 == 0)):
        for feed, rows in ((WEATHER, raw.weather), (AIR, raw.air), (RIVER, raw.river), (OBSERVED, raw.observed)):
            files.append_raw(rows.where(mine), at[feed.name], feed, run)
        plans.refresh_runs(spark, f"{top}/history", at, fixtures.normals_of(raw))
    return spark.read.parquet(f"{top}/history")


def raw_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw weather of which some rows lack a site or a time, with what becomes of each row."""
    k, raw = F.col("event_id"), fixtures.raw_tables(spark, sf_dir).weather
    raw = raw.withColumns({"city_id": F.when(k % 23 != 0, F.col("city_id")), "valid_ts_utc": F.when(k % 29 != 0, F.col("valid_ts_utc"))})
    good, bad = files.split_required(raw, WEATHER)
    columns = ["event_id", "city_id", "valid_ts_utc"]
    return good.select(*columns, F.lit(None).cast("string").alias("reason")).union(bad.select(*columns, "reason"))


def raw_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every site under a new run: one id of the right form and one time for all."""
    raw = fixtures.raw_tables(spark, sf_dir).weather.drop("ingestion_run_id", "ingested_at_utc")
    run, made = F.col("ingestion_run_id"), F.col("ingested_at_utc")
    return files.stamp(raw, *files.new_run()).groupBy("city_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(run).alias("runs"), F.countDistinct(made).alias("times"),
        F.bool_and(run.rlike(r"^\d{8}T\d{6}Z-[0-9a-f]{12}$") & (F.date_format(made, "yyyyMMdd'T'HHmmss'Z'") == F.substring_index(run, "-", 1))).alias("named_by_time"),
    )


def sites_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "sites")
    fixtures.sites_of(spark, sf_dir).select(*SITES.names).write.csv(at, header=True)
    return plain(files.sites(spark, at))


def normals_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "normals")
    analysis.climatology(models(spark, sf_dir)["latest_observed"]).select(*NORMALS.names).write.csv(at, header=True)
    return plain(files.normals(spark, at))


def risk_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of today in UTC, over a history moved to today."""
    now = F.to_date(F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")))
    history = models(spark, sf_dir)["risk_history"].withColumn("date", F.date_add("date", F.datediff(now, F.lit(AS_OF))))
    return current.risk_current(history)


def latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """latest_weather by way of a stream of the raw rows in several files."""
    top, raw = _place(spark, "stream"), fixtures.raw_tables(spark, sf_dir).weather
    raw.repartition(4, "event_id").write.parquet(f"{top}/source")
    stream_latest(spark, f"{top}/source", raw.schema, f"{top}/target", ["city_id", "valid_ts_utc"], "valid_ts_utc", f"{top}/checkpoint", 2).awaitTermination()
    return plain(read_latest(spark, f"{top}/target", raw.schema).drop("_day"))


def risk_rank_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of 1,500 sites by scores of six digits, which are hardly ever equal."""
    raw = fixtures.raw_tables(spark, sf_dir, MANY)
    panel = plans.panel_of(raw.weather, raw.air, raw.river, raw.observed)
    return current.risk_current(scoring.risk_history(panel, fixtures.normals_of(raw), ScoringConfig(digits=6)), AS_OF, rank="range")


def zone_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of 1,500 sites by zone, a hundred names a row."""
    return plain(current.zone_members(models(spark, sf_dir, MANY)["risk_current"], chunk=100))


def velocity_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """velocity in blocks of three days."""
    based = scoring.with_baseline(models(spark, sf_dir)["signal_panel"], fixtures.normals_of(fixtures.raw_tables(spark, sf_dir)))
    return scoring.with_velocity_in_blocks(based, 3).select("city_id", "date", "temp_velocity", "river_velocity_pct")


def panel_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal_panel over stored tables that need no shuffle."""
    top, m, tag = _place(spark, "buckets"), models(spark, sf_dir), uuid.uuid4().hex
    names = ("daily_weather", "daily_air", "latest_river", "latest_observed")
    return plain(staging.signal_panel(*(staging.bucketed(m[n], f"{n}_{tag}", f"{top}/{n}", 8) for n in names)))


def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the weather's payload files, of which some are broken and some too large: for every run,
    site and reason the files, and the rows of the good ones."""
    at = _place(spark, "landing")
    payloads = fixtures.damaged(fixtures.payloads(fixtures.raw_tables(spark, sf_dir).weather, WEATHER))
    vast = F.col("city_id").endswith("2") & (F.substring("ingestion_run_id", -2, 2).cast("int") % 7 == 0)
    landing.land(payloads.withColumn("payload", F.when(vast, F.rpad("payload", 400_000, " ")).otherwise(F.col("payload"))), at)
    rows, errors = landing.read_landed(spark, at, WEATHER, 300_000)
    good = rows.groupBy("ingestion_run_id", "city_id").agg(F.lit("good").alias("reason"), F.count(F.lit(1)).alias("rows"))
    bad = errors.groupBy("ingestion_run_id", "city_id", "reason").agg(F.lit(0).cast("long").alias("rows"))
    return good.unionByName(bad)


def risk_history_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score history by plain SQL over temporary views."""
    m = models(spark, sf_dir) | {"normals": fixtures.normals_of(fixtures.raw_tables(spark, sf_dir))}
    return sql.risk_history(spark, sql.register(spark, m, f"v{uuid.uuid4().hex[:8]}_"))


def climatology_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """climatology of a state that grew: early days, later ones, and a day put in twice and taken back."""
    daily = models(spark, sf_dir)["latest_observed"]
    day = F.dayofmonth("date")
    parts = [analysis.climatology_state(daily.where(day <= 12)), analysis.climatology_state(daily.where(day >= 12)), analysis.climatology_state(daily.where(day == 12), -1)]
    return plain(analysis.climatology_of(analysis.merged_climatology(*parts)))


def history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of stored raw tables that follows a stream of half of the weather, batch by batch."""
    top, raw = _place(spark, "stream"), fixtures.raw_tables(spark, sf_dir)
    at, late = {f.name: f"{top}/{f.name}" for f in (WEATHER, AIR, RIVER, OBSERVED)}, F.col("event_id") % 2 == 1
    for feed, rows in ((WEATHER, raw.weather.where(~late)), (AIR, raw.air), (RIVER, raw.river), (OBSERVED, raw.observed)):
        files.append_raw(rows, at[feed.name], feed, "run-1")
    fixtures.normals_of(raw).write.parquet(f"{top}/normals")
    normals = spark.read.parquet(f"{top}/normals")
    plans.refresh_runs(spark, f"{top}/history", at, normals)
    raw.weather.where(late).select(WEATHER.raw_schema.fieldNames()).repartition(4, "city_id", "valid_ts_utc").write.parquet(f"{top}/source")
    stream_history(spark, f"{top}/source", WEATHER, at, f"{top}/history", normals, f"{top}/checkpoint", 2).awaitTermination()
    return spark.read.parquet(f"{top}/history")


MODELS = ("latest_weather", "latest_air", "latest_river", "latest_observed", "daily_weather", "daily_air", "signal_panel", "risk_history", "risk_current", "zone_summary")


def queries() -> dict[str, Query]:
    named = (
        baseline_join, velocity, factor_scores, risk_rank_histogram, ranking, trend, factor_unpivot, site_map, zone_counts,
        quality_report, completeness, run_summary, payload_errors, sites_active, run_windows, climatology,
        forecast_deviation, projection_deviation, coverage_gaps, history_incremental, history_published,
        latest_stream, raw_appended, raw_required, raw_stamped, sites_file, normals_file, risk_today, raw_replayed, history_by_runs, history_stream,
        risk_rank_range, zone_members, velocity_blocks, panel_bucketed, landed_files, risk_history_sql, climatology_merged, quality_lazy,
    )
    return {m: _model(m) for m in MODELS} | {p: _payload(p) for p in fixtures.FEED_OF} | {f.__name__: f for f in named}
