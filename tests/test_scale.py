"""Forms of the models for sizes at which one task, one row or one more shuffle would be too much."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeline import fixtures, plans, sql
from gaugeline.operators import analysis, current, quality, ranges, scoring, staging
from gaugeline.queries import AS_OF, models
from gaugeline.sources import landing
from gaugeline.sources.feeds import WEATHER

SF = "/root/testdata/sf0.001"


def executed(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan


def scores(spark, n):
    """Scores of which a third are equal and some null."""
    score = "case when id % 3 = 0 then 50.0D when id % 17 = 0 then null else pmod(hash(id), 9973) / 7.0D end"
    return spark.range(n).selectExpr("concat('s', id) city_id", "date'2024-01-15' date", f"{score} global_tipping_score", "'Heat' primary_driver")


def test_range_rank_equals_window_rank(spark):
    h = scores(spark, 3000)
    a, b = (current.risk_current(h, date(2024, 1, 15), rank=k).select("city_id", "rank") for k in ("window", "range"))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == 3000
    plan = executed(b)
    assert "SinglePartition" not in plan and "Window" in plan
    assert current.risk_current(h.limit(0), date(2024, 1, 15), rank="range").count() == 0
    with pytest.raises(ValueError):
        current.risk_current(h, rank="other")


def test_sums_before_within_groups(spark):
    rows = [(g, k, (k * 7 + g) % 5) for g in range(3) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, k int, v long").repartition(7)
    got = {(r["g"], r["k"]): r["b"] for r in ranges.with_sum_before(df, [F.desc("k")], "v", "b", ("g",)).collect()}
    assert got == {(g, k): sum(v for h, j, v in rows if h == g and j > k) for g, k, _ in rows}


def test_members_of_zones_are_complete_in_chunks(spark):
    current_rows = current.risk_current(scores(spark, 1500), date(2024, 1, 15))
    rows = sorted(current.zone_members(current_rows, chunk=70).collect(), key=lambda r: (r["zone_order"], r["chunk"]))
    whole = {}
    for r in rows:
        whole.setdefault(r["zone_order"], []).append(r["cities"])
        assert len(r["cities"].split(", ")) <= 70
    want = {r["zone_order"]: r["x"] for r in current.with_zone(current_rows).groupBy("zone_order").agg(F.array_join(F.array_sort(F.collect_list("city_id")), ", ").alias("x")).collect()}
    assert {z: ", ".join(x) for z, x in whole.items()} == want
    assert {r["chunk"] for r in rows if r["zone_order"] == 4} == set(range(-(-len(want[4].split(", ")) // 70)))
    summary = {r["zone_name"]: r["names_cut"] for r in current.zone_summary(current_rows, max_items=300).collect()}
    assert set(summary.values()) == {True, False}


def test_velocity_in_blocks_spreads_one_site(spark):
    first, plain = date(1990, 1, 1), spark.conf.get("spark.sql.shuffle.partitions")
    rows = [("a", first + timedelta(k), float(k % 91), float(k % 13) or None) for k in range(4000) if k % 250 < 240 and not 1500 < k < 2100] + [("b", first, 1.0, 2.0), ("b", first + timedelta(3000), 4.0, 3.0)]
    df = spark.createDataFrame(rows, "city_id string, date date, temperature_2m_max double, river_discharge_m3s double")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, want = scoring.with_velocity_in_blocks(df, 100), scoring.with_velocity(df)
        assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == want.count()
        tasks = got.where("city_id = 'a'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks >= 8
        assert scoring.with_velocity_in_blocks(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", plain)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_the_panel_over_buckets_shuffles_nothing(spark, tmp_path):
    m, plain = models(spark, SF), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    names = ("daily_weather", "daily_air", "latest_river", "latest_observed")
    stored = [staging.bucketed(m[n], f"test_{n}", str(tmp_path / n), 4) for n in names]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        panel = staging.signal_panel(*stored)
        plan = executed(panel)
        assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan
        assert panel.exceptAll(m["signal_panel"]).count() == 0 and panel.count() == m["signal_panel"].count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)
        for n in names:
            spark.sql(f"DROP TABLE test_{n}")


def test_stored_models_are_computed_once_and_checked_on_the_way(spark, tmp_path):
    raw, seen = fixtures.raw_tables(spark, SF), spark.sparkContext.accumulator(0)
    normals = spark.createDataFrame(fixtures.normals_of(raw).collect())

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    weather = raw.weather.mapInArrow(counted, raw.weather.schema)
    stored, report = plans.store_models(spark, str(tmp_path / "m"), weather, raw.air, raw.river, raw.observed, normals, AS_OF)
    assert seen.value == raw.weather.count()
    want = plans.build(raw.weather, raw.air, raw.river, raw.observed, normals, AS_OF)
    assert set(stored) == set(want)
    for name in ("signal_panel", "risk_history", "risk_current", "zone_summary"):
        a = want[name].select(stored[name].columns)
        assert a.exceptAll(stored[name]).count() == 0 and a.count() == stored[name].count()
    lazy = {tuple(r) for r in quality.run_checks(want).collect()}
    assert {tuple(r) for r in report.collect()} == lazy and len(lazy) == 22


def test_repeated_values_are_counted_with_the_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), (None, 3), (None, None), ("c", 1), ("c", 1), ("c", 1)], "city_id string, x int")
    specs = (quality.Check("m", "city_id", "unique"), quality.Check("m", "city_id", "not_null"), quality.Check("m", "x", "not_null"), quality.Check("m", "x", "unique"))
    assert {(r["column"], r["check"]): r["violations"] for r in quality.run_checks({"m": df}, specs).collect()} == {("city_id", "unique"): 2, ("city_id", "not_null"): 2, ("x", "not_null"): 2, ("x", "unique"): 1}
    assert all(r["passed"] for r in quality.run_checks({"m": df.limit(0)}, specs).collect())


def test_landed_files_one_by_one(spark, tmp_path):
    good = '{"hourly": {"time": ["2024-01-01T00:00"], "temperature_2m": [1.0], "precipitation": [0.0], "wind_speed_10m": [1], "wind_gusts_10m": [2], "weather_code": [3]}}'
    files = {"a": good.encode(), "b": b"{", "c": b"\xff\xfe\x00bad", "d": b"", "e": good.encode() + b" " * 5000, "f": good.replace("[1.0]", "[]").encode()}
    for site, content in files.items():
        folder = tmp_path / "in" / "ingestion_run_id=r1" / f"city_id={site}"
        folder.mkdir(parents=True)
        (folder / "payload.json").write_bytes(content)
    rows, errors = landing.read_landed(spark, str(tmp_path / "in"), WEATHER, 1000)
    assert [(r["city_id"], r["ingestion_run_id"], r["temperature_2m"], r["file"].endswith("city_id=a/payload.json")) for r in rows.collect()] == [("a", "r1", 1.0, True)]
    assert {r["city_id"]: r["reason"] for r in errors.collect()} == {"b": "corrupt_json", "c": "bad_encoding", "e": "too_large", "f": "short_array"}
    assert all(r["file"].endswith("payload.json") for r in errors.collect())


def test_sql_functions_keep_the_rules(spark):
    sql.register(spark, {"given": spark.createDataFrame([(1.005, None), (-3.0, 2.0), (250.0, 1.0)], "x double, y double")}, "t_")
    rows = spark.sql("SELECT q_round2(x), clamp(x, 0, 100), null_greatest(x, y), null_least(x, y), clamp(y, 0, 1), flag('TRUE'), flag(NULL) FROM t_given").collect()
    assert [tuple(r) for r in rows] == [(1.01, 1.005, None, None, None, True, False), (-3.0, 0.0, 2.0, -3.0, 1.0, True, False), (250.0, 100.0, 250.0, 1.0, 1.0, True, False)]


def test_a_climatology_grows_and_takes_back(spark):
    daily = models(spark, SF)["latest_observed"]
    day = F.dayofmonth("date")
    state = lambda df, sign=1: analysis.climatology_state(df, sign)
    old, revised = daily.where(day < 9), daily.where(day == 4).withColumn("temperature_2m_max", F.lit(99.0))
    merged = analysis.merged_climatology(state(old), state(daily.where(day >= 9)), state(daily.where(day == 4), -1), state(revised))
    want = analysis.climatology(daily.where(day != 4).unionByName(revised))
    got = analysis.climatology_of(merged)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    none = analysis.merged_climatology(state(old), state(old, -1))
    assert none.count() == 0 and analysis.climatology_of(state(daily.limit(0))).count() == 0
