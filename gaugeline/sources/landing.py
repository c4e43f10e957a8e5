"""Payload files as they land: found with their names, bounded in size, and set aside if they cannot be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.sources.feeds import Feed
from gaugeline.sources.payloads import parse_payload

KEYS = ("ingestion_run_id", "city_id")


def land(payloads: DataFrame, path: str) -> None:
    """Writes payloads (city_id, ingestion_run_id, payload), a file each, in a folder for every run and site."""
    payloads.select(*KEYS, "payload").write.partitionBy(*KEYS).option("maxRecordsPerFile", 1).mode("append").text(path)


def read_landed(spark: SparkSession, path: str, feed: Feed, most_bytes: int = 64_000_000) -> tuple[DataFrame, DataFrame]:
    """Rows and errors of the payload files in the folders run=../city_id=.. under path, as parse_payload has them.

    Both hold `file`. Files of more than most_bytes are errors (too_large) and are not opened; nor do files that
    are not UTF-8 (bad_encoding) or hold a broken payload stop the others. Files without a byte are skipped."""
    found = spark.read.format("binaryFile").schema(f"path string, modificationTime timestamp, length long, content binary, {KEYS[0]} string, {KEYS[1]} string").load(path)
    keys = [F.col(k).cast("string").alias(k) for k in KEYS]
    large = found.where(F.col("length") > most_bytes).select(*keys, F.col("path").alias("file"), F.lit(feed.name).alias("feed"), F.lit("too_large").alias("reason"))
    text = F.col("content").cast("string")
    small = found.where(F.col("length") <= most_bytes).select(*keys, F.col("path").alias("file"), F.when(F.is_valid_utf8(text), text).alias("payload"))
    whole = small.where(F.col("payload").isNotNull())
    rows, errors = parse_payload(whole, feed)
    lost = small.where(F.col("payload").isNull()).select(*KEYS, "file", F.lit(feed.name).alias("feed"), F.lit("bad_encoding").alias("reason"))
    return rows, errors.unionByName(lost).unionByName(large)
