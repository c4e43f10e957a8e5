"""Reading the dimension files and raw tables, writing raw and published tables."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions import flag
from gaugeline.sources import marks
from gaugeline.sources.feeds import NORMALS, SITES, Feed


def active_sites(sites: DataFrame) -> DataFrame:
    """Sites whose `active` is true in any case, with river_enabled as a boolean that defaults to false."""
    return sites.where(flag(F.col("active"))).withColumn("river_enabled", flag(F.col("river_enabled")))


def sites(spark: SparkSession, path: str) -> DataFrame:
    return active_sites(spark.read.schema(SITES).csv(path, header=True))


def normals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NORMALS).csv(path, header=True)


def committed_runs(spark: SparkSession, path: str) -> list[str]:
    """The runs of a raw table that were written whole, in order of their ids."""
    return [n.removesuffix(".json") for n in marks.names(spark, f"{path}/runs")]


def read_raw(spark: SparkSession, path: str, feed: Feed, runs: Iterable[str] | None = None) -> DataFrame:
    """The rows of a raw table's committed runs, or of some of them; a filter on _day prunes its partitions.

    Only the folders of those runs are read, so what a run has left half-written is never seen."""
    schema = feed.raw_schema.add("_day", "date")
    whole = committed_runs(spark, path)
    chosen = whole if runs is None else sorted(set(runs) & set(whole))
    if not chosen:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/_run={r}" for r in chosen)).select(*schema.names)


def new_run() -> tuple[str, datetime]:
    """A run's id, unique, and its one time in UTC, both for stamp()."""
    at = datetime.now(UTC)
    return f"{at:%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:12]}", at


def stamp(df: DataFrame, run_id: str, ingested_at: datetime) -> DataFrame:
    """Adds the run's id and time, the same for all rows of a run."""
    return df.withColumns({"ingestion_run_id": F.lit(run_id), "ingested_at_utc": F.lit(ingested_at).cast("timestamp")})


def split_required(df: DataFrame, feed: Feed) -> tuple[DataFrame, DataFrame]:
    """Rows that hold all required columns, and the others with a reason."""
    required = [f.name for f in feed.raw_schema if not f.nullable and f.name in df.columns]
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in required))
    return df.where(~missing), df.where(missing).withColumn("reason", F.lit("missing_required"))


def by_day(df: DataFrame, day: str) -> DataFrame:
    """Deals rows to tasks by day. Spark joins small days and splits large ones by the sizes that it sees in
    the shuffle, so the rows are computed once and no day is one task."""
    return df.hint("rebalance", day)


def write_run(df: DataFrame, path: str, feed: Feed, run: str) -> int:
    """Writes a run's rows, in place of what an earlier attempt left; they are not seen until commit_run."""
    seen = Observation()
    columns = feed.raw_schema.fieldNames()
    rows = df.select(*columns).withColumn("_day", F.to_date(feed.time_column)).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.partitionBy("_day").mode("overwrite").parquet(f"{path}/rows/_run={run}")
    return seen.get["rows"]


def commit_run(spark: SparkSession, path: str, run: str, rows: int) -> None:
    """Makes a run's rows part of the table, by one small file that also tells their number."""
    marks.put(spark, f"{path}/runs", f"{run}.json", json.dumps({"run": run, "rows": rows}))


def append_raw(df: DataFrame, path: str, feed: Feed, run: str | None = None) -> bool:
    """Appends the rows of a run, exactly once, in day partitions; False if the run is there already.

    The table is made if absent, and other runs are not touched. A run that failed midway is not seen by
    readers, and is written anew when it is tried again. Without an id the rows are a run of their own."""
    spark, run = df.sparkSession, run or new_run()[0]
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run):
        raise ValueError(f"not the id of a run: {run!r}")
    if marks.exists(spark, f"{path}/runs/{run}.json"):
        return False
    commit_run(spark, path, run, write_run(df, path, feed, run))
    return True


def recover(spark: SparkSession, path: str) -> None:
    """Puts a table back whose replacement ended between its two renames."""
    if not marks.exists(spark, path) and marks.exists(spark, f"{path}.before"):
        marks.move(spark, f"{path}.before", path)


def publish(df: DataFrame, path: str, mode: str = "full", rows_per_file: int = 2_000_000) -> None:
    """Writes a table partitioned by date, in files of rows_per_file rows at most: all of it, or with "changed"
    only the dates that df holds.

    A full table is written beside the old one, which is replaced once the new one is whole."""
    if mode not in ("full", "changed"):
        raise ValueError(mode)
    spark = df.sparkSession
    recover(spark, path)
    writer = by_day(df, "date").write.option("maxRecordsPerFile", rows_per_file).partitionBy("date").mode("overwrite")
    if mode == "changed":
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)
        return
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    writer.parquet(fresh)
    marks.drop(spark, f"{path}.before")
    if marks.exists(spark, path):
        marks.move(spark, path, f"{path}.before")
    marks.move(spark, fresh, path)
    marks.drop(spark, f"{path}.before")
