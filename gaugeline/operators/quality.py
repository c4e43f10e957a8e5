"""Checks of built models, as rows instead of exceptions, and run summaries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    model: str
    column: str
    kind: str  # not_null or unique


#: The checks of the models.
CHECKS = (
    *(Check(m, c, "not_null") for m in ("latest_weather", "latest_air") for c in ("city_id", "valid_ts_utc")),
    *(Check(m, c, "not_null") for m in ("latest_river", "latest_observed", "daily_weather", "daily_air", "signal_panel") for c in ("city_id", "date")),
    *(Check("risk_history", c, "not_null") for c in ("city_id", "date", "global_tipping_score")),
    *(Check("risk_current", c, "not_null") for c in ("city_id", "current_tipping_score")),
    Check("zone_summary", "zone_name", "not_null"),
    Check("risk_current", "city_id", "unique"),
    Check("zone_summary", "zone_name", "unique"),
)


def not_null_counts(name: str, specs: tuple[Check, ...] = CHECKS) -> list[Column]:
    """For every not_null check of a model how many rows fail it, named by the column."""
    return [F.count_if(F.col(s.column).isNull()).alias(s.column) for s in specs if s.model == name and s.kind == "not_null"]


def repeated(df: DataFrame, column: str, *counts: str) -> DataFrame:
    """One row: the values of a column that occur more than once, and the sums of counts made on the way."""
    each = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in counts))
    twice = F.count_if(F.col(column).isNotNull() & (F.col("_n") > 1)).alias("_twice")
    return each.agg(twice, *(F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(f"_{c}") for c in counts))


def run_checks(models: dict[str, DataFrame], specs: tuple[Check, ...] = CHECKS) -> DataFrame:
    """(model, column, check, violations, passed), each model evaluated once for all its checks; unique counts
    the values that occur more than once. See plans.store_models for checks made while models are written."""
    parts = []
    row = lambda c, kind, n: F.struct(F.lit(c).alias("column"), F.lit(kind).alias("check"), n.alias("violations"))
    for name in dict.fromkeys(s.model for s in specs):
        filled = [s.column for s in specs if s.model == name and s.kind == "not_null"]
        unique = [s.column for s in specs if s.model == name and s.kind == "unique"]
        if unique:  # the counts of the others ride along with the first
            ones = [repeated(models[name], c, *(filled if k == 0 else ())) for k, c in enumerate(unique)]
            found = [one.select(F.array(row(c, "unique", F.col("_twice")), *(row(f, "not_null", F.col(f"_{f}")) for f in (filled if k == 0 else ()))).alias("x")) for k, (one, c) in enumerate(zip(ones, unique, strict=True))]
        else:
            found = [models[name].agg(F.array(*(row(c, "not_null", F.count_if(F.col(c).isNull())) for c in filled)).alias("x"))]
        parts += [f.select(F.lit(name).alias("model"), F.inline("x")) for f in found]
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.select("model", "column", "check", "violations", (F.col("violations") == 0).alias("passed"))


def incomplete_days(daily: DataFrame, expected: int = 24) -> DataFrame:
    return daily.where(F.col("hour_count") < expected).select("city_id", "date", "hour_count")


def run_summary(rows_by_feed: dict[str, DataFrame], errors: DataFrame) -> DataFrame:
    """Rows per feed, errors and status of every run: success without errors, partial_failure with errors
    and rows, failure with errors alone."""
    counted = [df.groupBy("ingestion_run_id").agg(F.count(F.lit(1)).alias("n")).select("ingestion_run_id", F.lit(f).alias("feed"), "n") for f, df in rows_by_feed.items()]
    counted.append(errors.groupBy("ingestion_run_id").agg(F.count(F.lit(1)).alias("n")).select("ingestion_run_id", F.lit("errors").alias("feed"), "n"))
    of = lambda f: F.coalesce(F.sum(F.when(F.col("feed") == f, F.col("n"))), F.lit(0)).alias(f)
    out = reduce(lambda a, b: a.union(b), counted).groupBy("ingestion_run_id").agg(*map(of, rows_by_feed), of("errors"))
    rows = sum(F.col(f) for f in rows_by_feed)
    return out.withColumn("status", F.when(F.col("errors") == 0, "success").when(rows > 0, "partial_failure").otherwise("failure"))
