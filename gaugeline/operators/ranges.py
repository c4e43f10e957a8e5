"""Sums over all earlier rows of an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.shared import stored


def with_sum_before(df: DataFrame, order: list[Column], value: str, name: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum of `value` over the rows of the same group that stand earlier in the order.

    Rows are dealt out in ranges of the order and written once, since another evaluation may cut other ranges.
    Sums within a range are made by its task; what the ranges before it hold is a number a range and group,
    which is what the driver adds up and tasks get. Rows that are equal in the order count each other by chance,
    so the order should tell them apart. `_range` and `_local` must not be columns."""
    spark = df.sparkSession
    parts = df.repartitionByRange(*(F.col(g) for g in groups), *order).withColumn("_range", F.spark_partition_id())
    rows, keys = stored(parts, "ranges"), [*groups, "_range"]
    totals = rows.groupBy(*keys).agg(F.sum(value).cast("long").alias("n")).collect()  # a row a range, and one more a group at most
    offsets, so_far = [], {}
    for r in sorted(totals, key=lambda r: r["_range"]):
        group = tuple(r[g] for g in groups)
        offsets.append((*group, r["_range"], so_far.get(group, 0)))
        so_far[group] = so_far.get(group, 0) + (r["n"] or 0)
    schema = ", ".join([*(f"{g} {dict(df.dtypes)[g]}" for g in groups), "_range int", "_local long"])
    within = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn(name, F.coalesce(within, F.lit(0)).cast("long")).join(F.broadcast(spark.createDataFrame(offsets, schema)), keys)
    return out.withColumn(name, F.col(name) + F.col("_local")).select(*df.columns, name)
