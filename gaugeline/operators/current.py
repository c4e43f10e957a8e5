"""The ranking of the next days, the zones, and the readers' queries."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.config import ZoneConfig
from gaugeline.operators.ranges import with_sum_before
from gaugeline.operators.scoring import FACTORS


def current_scores(history: DataFrame, as_of: date | None = None, horizon_days: int = 1) -> DataFrame:
    """Each site's largest score from as_of (today in UTC by default) to the horizon, and its driver.

    Of equal scores the earlier date's driver is taken."""
    day = F.lit(as_of).cast("date") if as_of else F.to_date(F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")))
    rows = history.where(F.col("date").between(day, F.date_add(day, horizon_days)))
    score, first = F.col("global_tipping_score"), F.struct(-F.col("global_tipping_score"), F.col("date"), F.col("primary_driver"))
    return rows.groupBy("city_id").agg(
        F.max(score).alias("current_tipping_score"),
        F.min(F.when(score.isNotNull(), first))["primary_driver"].alias("current_primary_driver"),
    )


def risk_current(history: DataFrame, as_of: date | None = None, horizon_days: int = 1, rank: str = "histogram") -> DataFrame:
    """current_scores with ranks, which have gaps; a null score comes last.

    The histogram rank counts sites per score, of which there are at most 1,001 of one digit, and joins the
    counts back. The range rank does the same for scores of any number of digits: scores are dealt out in
    ranges, and what the higher ranges hold is added. The window rank sorts all sites in one task and is meant
    for comparison."""
    current = current_scores(history, as_of, horizon_days)
    if rank == "window":
        return current.withColumn("rank", F.rank().over(Window.orderBy(F.desc_nulls_last("current_tipping_score"))).cast("long"))
    if rank not in ("histogram", "range"):
        raise ValueError(rank)
    above = Window.orderBy(F.desc_nulls_last("_score")).rowsBetween(Window.unboundedPreceding, -1)
    counts = current.groupBy(F.col("current_tipping_score").alias("_score")).agg(F.count(F.lit(1)).alias("_n"))
    if rank == "range":
        higher = with_sum_before(counts, [F.desc_nulls_last("_score")], "_n", "rank")
        ranks = higher.select("_score", (F.col("rank") + 1).alias("rank"))
        return current.join(ranks, F.col("current_tipping_score").eqNullSafe(F.col("_score"))).drop("_score")
    ranks = counts.select("_score", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias("rank"))
    return current.join(F.broadcast(ranks), F.col("current_tipping_score").eqNullSafe(F.col("_score"))).drop("_score")


def with_zone(current: DataFrame, cfg: ZoneConfig = ZoneConfig()) -> DataFrame:
    score = F.col("current_tipping_score")
    pick = lambda k: reduce(lambda w, z: F.when(score >= z[0], z[k]).otherwise(w), reversed(cfg.zones), F.lit(cfg.rest[k - 1]))
    return current.withColumns({"zone_name": pick(1), "zone_order": pick(2).cast("long")})


def zone_summary(current: DataFrame, cfg: ZoneConfig = ZoneConfig(), max_items: int | None = 1000) -> DataFrame:
    """Sites and drivers of every zone, alphabetically, most severe zone first; city_count counts all sites.

    cities_in_zone names the first max_items of a zone (all with None, for small dimensions): map tasks keep
    no more of them, so no row grows with the number of sites. names_cut tells whether there are more, which
    zone_members lists. Names and counts read the same rows, so that both use one exchange of the scores."""
    zoned = with_zone(current, cfg)
    zone, join = ["zone_name", "zone_order"], lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c), ", "))
    named = zoned
    if max_items is not None:
        # the driver orders nothing, as a site has one row; with it the rows needed here are those of the counts
        first = F.row_number().over(Window.partitionBy("zone_order").orderBy(F.asc_nulls_last("city_id"), "current_primary_driver"))
        named = named.withColumn("_n", first).where(F.col("_n") <= max_items)
    names = named.groupBy(*zone).agg(join(F.collect_list("city_id")).alias("cities_in_zone"))
    counts = zoned.groupBy(*zone).agg(F.count("city_id").alias("city_count"), join(F.collect_set("current_primary_driver")).alias("drivers_in_zone"))
    out = counts.join(names, zone, "left")  # a row a zone on either side
    cut = F.lit(False) if max_items is None else F.col("city_count") > max_items
    return out.orderBy("zone_order").select("zone_name", "city_count", "cities_in_zone", "drivers_in_zone", cut.alias("names_cut"))


def zone_members(current: DataFrame, cfg: ZoneConfig = ZoneConfig(), chunk: int = 1000) -> DataFrame:
    """(zone_name, zone_order, chunk, cities): all sites of every zone in alphabetical order, `chunk` of them a row.

    Chunks are numbered from 0; put one after another they are the complete list of the zone."""
    sites = with_zone(current, cfg).where(F.col("city_id").isNotNull()).select("zone_name", "zone_order", "city_id", F.lit(1).alias("one"))
    nth = with_sum_before(sites, [F.col("city_id")], "one", "nth", ("zone_order",))
    rows = nth.groupBy("zone_name", "zone_order", F.floor(F.col("nth") / chunk).alias("chunk"))
    return rows.agg(F.array_join(F.array_sort(F.collect_list("city_id")), ", ").alias("cities"))


def ranking(current: DataFrame) -> DataFrame:
    return current.select("rank", "city_id", "current_tipping_score", "current_primary_driver").orderBy("rank", "city_id")


def trend(history: DataFrame, city_ids: list[str] | None = None) -> DataFrame:
    """The overall score of some sites, or of all, by date."""
    rows = history if city_ids is None else history.where(F.col("city_id").isin(city_ids))
    return rows.select("city_id", "date", "global_tipping_score").orderBy("city_id", "date")


def factor_long(history: DataFrame, city_id: str | None = None) -> DataFrame:
    """The five factors of one site, or of all, as rows (date, factor, score)."""
    rows = history if city_id is None else history.where(F.col("city_id") == city_id)
    return rows.unpivot(["city_id", "date"], list(FACTORS), "factor", "score")


def site_map(current: DataFrame, sites: DataFrame) -> DataFrame:
    return current.join(sites.select("city_id", "city_name", "latitude", "longitude"), "city_id")


def zone_counts(current: DataFrame, cfg: ZoneConfig = ZoneConfig()) -> DataFrame:
    return with_zone(current, cfg).groupBy("zone_name", "zone_order").agg(F.count("city_id").alias("city_count"))
