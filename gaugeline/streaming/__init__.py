"""The raw feed as a stream: an upsert that keeps the newest revision, however late it comes, or a history of
scores that follows the stream.

For the upsert, a batch writes new versions of the days that it touches under target/days/_v=<batch>, and then one small
file under target/commits that makes them current. Until that file is there, readers see the versions
before; a batch that failed midway is run again under its own number from the versions before it, so a
replay gives the same table whether or not the first attempt was committed. Every COMPACT batches the commits
of the batches before are put together in one, so their number stays bounded.

For the history, a batch is a run of the raw table: it is appended once and then taken up by the history, which
scores again what the run has changed.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, StructField, StructType

from gaugeline.config import ScoringConfig
from gaugeline.operators.staging import TIES, latest
from gaugeline.plans import refresh_runs
from gaugeline.sources import marks
from gaugeline.sources.feeds import Feed
from gaugeline.sources.files import append_raw, by_day

COMPACT = 20


def versions(spark: SparkSession, target: str, before: int | None = None) -> dict[date | None, int]:
    """The current version of every day, or the one before a batch; a row a day reaches the driver."""
    if not marks.exists(spark, f"{target}/commits"):
        return {}
    rows = spark.read.schema("_day date, _v long").option("recursiveFileLookup", "true").json(f"{target}/commits")
    if before is not None:
        rows = rows.where(F.col("_v") < before)
    return {r["_day"]: r["v"] for r in rows.groupBy("_day").agg(F.max("_v").alias("v")).collect()}


def _folder(target: str, day: date | None, version: int) -> str:
    return f"{target}/days/_v={version}/_day={day or '__HIVE_DEFAULT_PARTITION__'}"


def read_latest(spark: SparkSession, target: str, schema: StructType, before: int | None = None, days: set | None = None) -> DataFrame:
    """The table that upsert() keeps, with _day, a filter on which reads no other days."""
    schema = StructType([*(f for f in schema if f.name != "_day"), StructField("_day", DateType())])
    paths = [_folder(target, d, v) for d, v in versions(spark, target, before).items() if days is None or d in days]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{target}/days").parquet(*paths).select(*schema.names)


def commit(spark: SparkSession, target: str, batch_id: int, days: list[date | None]) -> None:
    """Makes the batch's versions of the days current, by one file."""
    rows = spark.createDataFrame([(d, batch_id) for d in days], "_day date, _v long")
    rows.coalesce(1).write.mode("overwrite").json(f"{target}/commits/{batch_id}")


def compact(spark: SparkSession, target: str, batch_id: int) -> None:
    """Puts the commits of all batches before this one together in one that keeps each day's newest version.

    The batch's own commit is left as it is, so that it can be replayed from the versions before it."""
    old = [n for n in marks.names(spark, f"{target}/commits") if int(n.removeprefix("to-")) < batch_id]
    if len(old) < 2:
        return
    newest = versions(spark, target, before=batch_id)
    rows = spark.createDataFrame(list(newest.items()), "_day date, _v long")
    rows.coalesce(1).write.mode("overwrite").json(f"{target}/commits/to-{batch_id - 1}")
    for name in old:
        if name != f"to-{batch_id - 1}":
            marks.drop(spark, f"{target}/commits/{name}")


def upsert(batch: DataFrame, batch_id: int, target: str, keys: list[str], time_column: str, rows_per_file: int = 2_000_000) -> None:
    """Merges a batch into the days that it touches; other days are neither read nor written.

    Versions older than the one before the batch's are deleted."""
    spark = batch.sparkSession
    if batch_id % COMPACT == 0:
        compact(spark, target, batch_id)
    batch = batch.withColumn("_day", F.to_date(time_column)).persist()
    try:
        days = [r["_day"] for r in batch.select("_day").distinct().collect()]
        if not days:
            return
        held = read_latest(spark, target, batch.schema, before=batch_id, days=set(days))
        merged = latest(batch.unionByName(held), keys, tiebreak=TIES)
        by_day(merged, "_day").write.option("maxRecordsPerFile", rows_per_file).partitionBy("_day").mode("overwrite").parquet(f"{target}/days/_v={batch_id}")
        was, older = versions(spark, target, before=batch_id), {}
        if was:
            older = versions(spark, target, before=max(was.values()))
        commit(spark, target, batch_id, days)
        for d in days:
            if d in older and older[d] < was.get(d, -1):
                marks.drop(spark, _folder(target, d, older[d]))
    finally:
        batch.unpersist()


def stream_latest(spark: SparkSession, source: str, schema: StructType, target: str, keys: list[str], time_column: str, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Starts a query that upserts every new file under source into target and stops when none is left.

    Watermarked aggregation would drop revisions that come later than its delay; this keeps them."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(source)
        .writeStream.foreachBatch(lambda batch, batch_id: upsert(batch, batch_id, target, keys, time_column))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_history(
    spark: SparkSession, source: str, feed: Feed, raw: dict[str, str], history: str, normals: DataFrame, checkpoint: str, files_per_batch: int | None = None, cfg: ScoringConfig = ScoringConfig()
) -> StreamingQuery:
    """Starts a query that appends every new file under source to the feed's raw table and brings the history up to it.

    `raw` names the raw tables of all feeds. A batch is the run stream-<number>: when it is replayed, its rows are
    there already and are not appended twice, and a history that has taken it up does not change."""
    reader = spark.readStream.schema(feed.raw_schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def take_up(batch: DataFrame, batch_id: int) -> None:
        append_raw(batch, raw[feed.name], feed, f"stream-{batch_id:09d}")
        refresh_runs(spark, history, raw, normals, cfg)

    return reader.parquet(source).writeStream.foreachBatch(take_up).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
