"""Models composed into one logical plan, and the incremental refresh."""

from __future__ import annotations

import re
import uuid
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.config import ScoringConfig, ZoneConfig
from gaugeline.operators import current, quality, scoring, staging
from gaugeline.shared import shared_folder, stored
from gaugeline.sources import files, marks
from gaugeline.sources.feeds import AIR, FEEDS, OBSERVED, RIVER, WEATHER


def panel_of(weather: DataFrame, air: DataFrame, river: DataFrame, observed: DataFrame) -> DataFrame:
    """The panel from raw feeds."""
    return staging.signal_panel(
        staging.daily_weather(staging.latest_weather(weather)), staging.daily_air(staging.latest_air(air)), staging.latest_river(river), staging.latest_observed(observed)
    )


def build(
    weather: DataFrame, air: DataFrame, river: DataFrame, observed: DataFrame, normals: DataFrame, as_of: date | None = None, scoring_cfg: ScoringConfig = ScoringConfig(), zones: ZoneConfig = ZoneConfig()
) -> dict[str, DataFrame]:
    """Every model by name, all lazy."""
    models = {
        "latest_weather": staging.latest_weather(weather),
        "latest_air": staging.latest_air(air),
        "latest_river": staging.latest_river(river),
        "latest_observed": staging.latest_observed(observed),
    }
    models["daily_weather"] = staging.daily_weather(models["latest_weather"])
    models["daily_air"] = staging.daily_air(models["latest_air"])
    models["signal_panel"] = staging.signal_panel(models["daily_weather"], models["daily_air"], models["latest_river"], models["latest_observed"])
    models["risk_history"] = scoring.risk_history(models["signal_panel"], normals, scoring_cfg)
    models["risk_current"] = current.risk_current(models["risk_history"], as_of)
    models["zone_summary"] = current.zone_summary(current.current_scores(models["risk_history"], as_of), zones)
    return models


def store_models(
    spark: SparkSession, path: str, weather: DataFrame, air: DataFrame, river: DataFrame, observed: DataFrame, normals: DataFrame, as_of: date | None = None, scoring_cfg: ScoringConfig = ScoringConfig(),
    zones: ZoneConfig = ZoneConfig(), specs: tuple[quality.Check, ...] = quality.CHECKS,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every model written under path, and the report of its checks (model, column, check, violations, passed).

    A model is computed once, from the stored ones before it. Its missing values are counted as its rows go by
    to be written; values that repeat are counted in the stored column alone."""
    models: dict[str, DataFrame] = {}
    report: list[tuple[str, str, str, int, bool]] = []

    def put(name: str, df: DataFrame) -> None:
        counts, seen, at = quality.not_null_counts(name, specs), Observation(), f"{path}/{name}"
        checked = df.observe(seen, *counts) if counts else df
        if name == "risk_history":
            files.publish(checked, at)
        else:
            checked.write.mode("overwrite").parquet(at)
        models[name] = spark.read.schema(df.schema).parquet(at)
        report.extend((name, c, "not_null", n, n == 0) for c, n in (seen.get.items() if counts else ()))
        for s in specs:
            if s.model == name and s.kind == "unique":
                n = quality.repeated(models[name], s.column).first()["_twice"]
                report.append((name, s.column, "unique", n, n == 0))

    put("latest_weather", staging.latest_weather(weather))
    put("latest_air", staging.latest_air(air))
    put("latest_river", staging.latest_river(river))
    put("latest_observed", staging.latest_observed(observed))
    put("daily_weather", staging.daily_weather(models["latest_weather"]))
    put("daily_air", staging.daily_air(models["latest_air"]))
    put("signal_panel", staging.signal_panel(models["daily_weather"], models["daily_air"], models["latest_river"], models["latest_observed"]))
    put("risk_history", scoring.risk_history(models["signal_panel"], normals, scoring_cfg))
    put("risk_current", current.risk_current(models["risk_history"], as_of))
    put("zone_summary", current.zone_summary(models["risk_current"], zones))
    return models, spark.createDataFrame(report, "model string, column string, check string, violations long, passed boolean")


def _changed_rows(feeds: tuple[DataFrame, ...], changed: DataFrame, days: list[date]) -> DataFrame:
    """The panel's rows of the changed (city_id, date); of feeds with _day only those partitions are read."""

    def of_changed(raw: DataFrame) -> DataFrame:
        day = F.to_date("valid_ts_utc") if "valid_ts_utc" in raw.columns else F.col("date")
        if "_day" in raw.columns:
            raw = raw.where(F.col("_day").isin(days))
        near = changed.withColumnRenamed("date", "_date")
        return raw.withColumn("_date", day).join(near, ["city_id", "_date"], "left_semi").drop("_date", "_day")

    return panel_of(*map(of_changed, feeds)).select("city_id", "date", *scoring.CONTEXT)


def refresh_history(existing: DataFrame, feeds: tuple[DataFrame, DataFrame, DataFrame, DataFrame], changed: DataFrame, normals: DataFrame, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """The history after the raw rows of some (city_id, date) changed; the result equals a full rebuild.

    Of the raw feeds (weather, air, river, observed) only the changed sites and days are read, down to the
    partitions of those days where a feed has _day; what else a score needs stands in the history. Scored
    again are the changed rows and the row before each, whose velocity looks ahead. A date that left the
    panel must be among the changed ones."""
    on, context = ["city_id", "date"], scoring.CONTEXT
    changed = stored(changed.select(*on).distinct(), "changed")  # small, and read several times
    days = [r["date"] for r in changed.select("date").distinct().collect()]  # a row a day, so that partitions are pruned in planning
    fresh = _changed_rows(feeds, changed, days)
    sites = changed.select("city_id").distinct()
    scores = [c for c in existing.columns if c not in on]
    old = existing.join(sites, "city_id", "left_semi").join(changed, on, "left_anti").select(*on, *context, F.struct(*scores).alias("_old"), F.lit(False).alias("_gone"))
    new = changed.join(fresh.withColumn("_here", F.lit(True)), on, "left").select(*on, *context, F.lit(None).cast(old.schema["_old"].dataType).alias("_old"), F.col("_here").isNull().alias("_gone"))
    following = F.lead(F.col("_old").isNull()).over(Window.partitionBy("city_id").orderBy("date"))
    rows = old.unionByName(new).withColumn("_again", F.col("_old").isNull() | F.coalesce(following, F.lit(False))).where("not _gone")
    again = scoring.scored(rows, normals, cfg).select(*on, *(F.when(F.col("_again"), F.col(c)).otherwise(F.col("_old")[c]).alias(c) for c in scores))
    return existing.join(sites, "city_id", "left_anti").unionByName(again.select(*existing.columns))


def _stored_days(spark: SparkSession, path: str) -> list[date]:
    """The dates of a published table, from the names of its partitions."""
    return [date.fromisoformat(n.removeprefix("date=")) for n in marks.names(spark, path) if re.fullmatch(r"date=\d{4}-\d{2}-\d{2}", n)]


def refresh_published(spark: SparkSession, path: str, feeds: tuple[DataFrame, DataFrame, DataFrame, DataFrame], changed: DataFrame, normals: DataFrame, cfg: ScoringConfig = ScoringConfig(), reach: int = 7) -> None:
    """A published history after the raw rows of some (city_id, date) changed; equal to a full rebuild.

    Scored again are the changed rows and the row before each. Which row that is, and which one follows, is
    looked up in the stored dates of `reach` days around the changed ones, and for the sites that have none
    there, in all dates (two columns of those sites). Of the history only the dates of rows to be scored and of
    the rows that follow them are read, and only the former are written. Run again after a failure midway, it
    gives the same table. A date that left the panel must be among the changed ones."""
    on, context, top = ["city_id", "date"], list(scoring.CONTEXT), f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}"
    files.recover(spark, path)

    def aside(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{top}/{name}")
        return spark.read.schema(df.schema).parquet(f"{top}/{name}")

    try:
        changed = aside(changed.select(*on).where("city_id is not null and date is not null").distinct(), "changed")
        days = [r["date"] for r in changed.select("date").distinct().collect()]  # a row a day
        if not days:
            return
        fresh = aside(_changed_rows(feeds, changed, days), "fresh")
        present = _stored_days(spark, path)
        if not present:
            return files.publish(scoring.risk_history(fresh, normals, cfg), path)
        existing = spark.read.parquet(path)
        near = {d + timedelta(k) for d in days for k in range(-reach, reach + 1)} & set(present)
        keys = changed.join(fresh.select(*on, F.lit(True).alias("there")), on, "left").select(*on, F.lit(True).alias("new"), F.coalesce("there", F.lit(False)).alias("there"))
        sites = changed.select("city_id").distinct()

        def old_keys(of: DataFrame, dates: Column) -> DataFrame:
            rows = existing.where(dates).select(*on).join(of, "city_id", "left_semi").join(changed, on, "left_anti")
            return rows.select(*on, F.lit(False).alias("new"), F.lit(True).alias("there"))

        in_near = F.col("date").isin(near)
        known = keys.union(old_keys(sites, in_near))
        in_turn, missing = Window.partitionBy("city_id").orderBy("date"), set(present) - near
        day, before, after, open_ = F.col("date"), F.lag("date").over(in_turn), F.lead("date").over(in_turn), F.lit(False)
        if missing:  # the neighbours of a key may be further away
            early, late = F.date_sub(day, reach), F.date_add(day, reach)
            open_ = F.col("new") & ((F.coalesce(before < early, F.lit(True)) & (early > F.lit(min(missing)))) | (F.coalesce(after > late, F.lit(True)) & (late < F.lit(max(missing)))))

        def placed(known: DataFrame, is_open: Column, name: str) -> tuple[DataFrame, Row]:
            """The keys with what becomes of them, and the dates that this touches, which are dates of the calendar."""
            # a key that left the panel still stands before its neighbours here; what follows a row is the next key that is there
            follows = F.min(F.when(F.col("there"), day)).over(in_turn.rowsBetween(1, Window.unboundedFollowing))
            again = F.col("there") & (F.col("new") | F.coalesce(F.lead("new").over(in_turn), F.lit(False)))
            rows = aside(known.select(*on, "there", follows.alias("next_date"), again.alias("again"), is_open.alias("open")), name)
            sets = {"again": F.when(F.col("again"), day), "next": F.when(F.col("again"), F.col("next_date")), "gone": F.when(~F.col("there"), day)}
            return rows, rows.agg(*(F.collect_set(c).alias(n) for n, c in sets.items()), F.bool_or("open").alias("open")).first()

        rows, of = placed(known, open_, "keys")
        if of["open"]:
            rows, of = placed(known.union(old_keys(rows.where("open").select("city_id").distinct(), ~in_near)), F.lit(False), "all_keys")
        again, gone = rows.where("again"), rows.where("not there")
        written, needed = {*of["again"], *of["gone"]}, {*of["again"], *of["next"]}
        held = existing.where(F.col("date").isin(needed & set(present)))
        values = fresh.unionByName(held.join(changed, on, "left_anti").select(*on, *context))
        following = values.select("city_id", F.col("date").alias("next_date"), F.col("temperature_2m_max").alias("next_temperature"), F.col("river_discharge_m3s").alias("next_river"))
        panel = values.join(again.select(*on, "next_date"), on).join(following, ["city_id", "next_date"], "left")
        panel = scoring.with_baseline(panel, normals).withColumns(scoring.changes(F.col("next_temperature"), F.col("next_river")))
        scored = scoring.with_overall(scoring.with_factors(panel, cfg), cfg).select(*scoring.HISTORY)
        kept = existing.where(F.col("date").isin(written & set(present))).join(again.unionByName(gone).select(*on), on, "left_anti").select(*scoring.HISTORY)
        out = aside(scored.unionByName(kept), "rows")
        files.publish(out, path, "changed")
        left = {r["date"] for r in out.select("date").distinct().collect()} if of["gone"] else written
        for day in written - left:
            marks.drop(spark, f"{path}/date={day}")
    finally:
        marks.drop(spark, top)


def refresh_runs(spark: SparkSession, path: str, raw: dict[str, str], normals: DataFrame, cfg: ScoringConfig = ScoringConfig()) -> list[str]:
    """Brings a published history up to the committed runs of the raw tables (feed name -> path); returns the
    runs it has taken up as feed/run.

    Marks in `<path>.runs` say which runs are in the history; what is new is told by the other runs' rows alone.
    The first time all is built. The marks are set last, and the work gives the same again, so a refresh that
    fails midway is simply repeated."""
    by_feed = {f.name: f for f in FEEDS}
    files.recover(spark, path)
    done = set(marks.names(spark, f"{path}.runs"))
    new = {name: [r for r in files.committed_runs(spark, at) if f"{name}@{r}" not in done] for name, at in raw.items()}
    if not any(new.values()):
        return []
    feeds = tuple(files.read_raw(spark, raw[f.name], f) for f in (WEATHER, AIR, RIVER, OBSERVED))
    if done:
        keys = [files.read_raw(spark, at, by_feed[name], new[name]).select("city_id", F.col("_day").alias("date")) for name, at in raw.items() if new[name]]
        refresh_published(spark, path, feeds, reduce(DataFrame.union, keys), normals, cfg)
    else:
        files.publish(scoring.risk_history(panel_of(*(f.drop("_day") for f in feeds)), normals, cfg), path)
    taken = [f"{name}@{r}" for name, runs in new.items() for r in runs]
    for name in taken:
        marks.put(spark, f"{path}.runs", name)
    return [t.replace("@", "/") for t in taken]
