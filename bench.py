"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and twice to be timed, into a sink that takes every row or, of published tables, into files; the better
time counts. Site counts follow the users (n_sites=1500), so that the tables stay as large as the events.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from datetime import date
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from gaugeline import fixtures, plans, queries  # noqa: E402
from gaugeline.operators import current, scoring, staging  # noqa: E402
from gaugeline.sources import files  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SITES = 1500
REVISIONS = 200  # of every raw row in the stored tables; forecasts are made again every day for a week or more


def latest_by_aggregate(raw):
    """The other form of latest_weather, an aggregate of structs instead of a window."""
    keys = ["city_id", "valid_ts_utc"]
    rest = [c for c in raw.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("ingested_at_utc", "ingestion_run_id", "event_id"))
    return raw.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def refreshed(spark):
    """A rebuild of the published history from stored raw tables, and a refresh of it after 1 % of the (site, day)
    changed, over the same files: raw in day partitions, history and normals as published. Both write."""
    top, raw = tempfile.mkdtemp(prefix="gaugeline-bench-"), fixtures.raw_tables(spark, SF_DIR, SITES)
    feeds = []
    for name in ("weather", "air", "river", "observed"):
        df = getattr(raw, name).withColumn("revision", F.explode(F.sequence(F.lit(1), F.lit(REVISIONS))))
        df = df.withColumn("ingested_at_utc", F.col("ingested_at_utc") - F.make_dt_interval(F.lit(0), REVISIONS - F.col("revision")))
        df.withColumn("_day", F.to_date("valid_ts_utc" if "valid_ts_utc" in df.columns else "date")).repartition("_day").write.partitionBy("_day").parquet(f"{top}/{name}")
        feeds.append(spark.read.parquet(f"{top}/{name}"))
    fixtures.normals_of(raw).write.parquet(f"{top}/normals")
    normals = spark.read.parquet(f"{top}/normals")
    rebuild = lambda to: files.publish(scoring.risk_history(plans.panel_of(*(f.drop("_day") for f in feeds)), normals), to)
    rebuild(f"{top}/history")
    history = spark.read.parquet(f"{top}/history")
    # a run brings all sites of a day or two: 1 % of the keys, in the last days
    history.select("city_id", "date").where(F.col("date") >= F.lit("2024-01-29")).where(F.pmod(F.xxhash64("city_id"), F.lit(100)) < 15).write.parquet(f"{top}/changed")
    changed = spark.read.parquet(f"{top}/changed")
    yield "history_rebuild", lambda: rebuild(f"{top}/again")
    yield "history_refresh", lambda: plans.refresh_published(spark, f"{top}/history", tuple(feeds), changed, normals)


def headline(spark):
    raw = fixtures.raw_tables(spark, SF_DIR, SITES)
    models = queries.models(spark, SF_DIR, SITES)
    yield "latest_weather", models["latest_weather"]
    yield "latest_weather_aggregate", latest_by_aggregate(raw.weather)
    yield "daily_weather", staging.daily_weather(staging.latest_weather(raw.weather))
    yield "signal_panel", models["signal_panel"]
    yield "risk_history", models["risk_history"]
    yield "risk_current", models["risk_current"]
    yield "risk_rank_range", current.risk_current(models["risk_history"], date(2024, 1, 15), rank="range")
    yield "risk_rank_window", current.risk_current(models["risk_history"], date(2024, 1, 15), rank="window")
    yield "zone_summary", models["zone_summary"]
    yield "payload_weather", queries.queries()["payload_weather"](spark, SF_DIR)
    yield from refreshed(spark)
    yield "panel_small", plans.panel_of(*(getattr(fixtures.raw_tables(spark, SF_DIR), t) for t in ("weather", "air", "river", "observed")))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, df in headline(spark):
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            df() if callable(df) else df.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs[1:]), 3)
    print(json.dumps({"metric": "sum of best query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
