"""Where intermediate tables go that every executor must read."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _of_this_machine() -> str:
    return tempfile.mkdtemp(prefix="gaugeline-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is unset, a session whose executors are threads of this machine (local[*], as in tests) gets
    a temporary folder; on a cluster that is an error, as other machines could not read it."""
    if top := spark.conf.get("spark.checkpoint.dir", None):
        return top
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _of_this_machine()
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read from it, so that it is computed once."""
    spark, at = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
