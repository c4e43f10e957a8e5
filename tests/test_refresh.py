"""Raw tables by runs, published tables that fail midway, and refreshes of stored histories."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeline import fixtures, plans
from gaugeline.operators import scoring
from gaugeline.sources import files, marks
from gaugeline.sources.feeds import AIR, OBSERVED, RIVER, WEATHER

SF = "/root/testdata/sf0.001"


def same(a, b):
    b = b.select(a.columns)
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def raw_weather(spark):
    return fixtures.raw_tables(spark, SF).weather


def test_a_replayed_run_adds_nothing_and_a_half_written_one_is_not_seen(spark, tmp_path):
    at, raw = str(tmp_path / "t"), raw_weather(spark)
    assert files.append_raw(raw.where("event_id % 2 = 0"), at, WEATHER, "a")
    files.write_run(raw.where("event_id % 3 = 0"), at, WEATHER, "b")
    assert files.committed_runs(spark, at) == ["a"]
    assert files.read_raw(spark, at, WEATHER).count() == raw.where("event_id % 2 = 0").count()
    assert files.append_raw(raw.where("event_id % 2 = 1"), at, WEATHER, "b")
    assert not files.append_raw(raw, at, WEATHER, "a")
    assert same(files.read_raw(spark, at, WEATHER).drop("_day"), raw.select(WEATHER.raw_schema.fieldNames()))
    assert same(files.read_raw(spark, at, WEATHER, ["b", "none"]).drop("_day"), raw.where("event_id % 2 = 1").select(WEATHER.raw_schema.fieldNames()))
    log = {r["run"]: r["rows"] for r in spark.read.json(f"{at}/runs").collect()}
    assert log == {"a": raw.where("event_id % 2 = 0").count(), "b": raw.where("event_id % 2 = 1").count()}
    with pytest.raises(ValueError):
        files.append_raw(raw, at, WEATHER, "a/../b")
    assert files.read_raw(spark, str(tmp_path / "absent"), WEATHER).count() == 0


def test_only_new_runs_are_scanned(spark, tmp_path):
    at, raw = str(tmp_path / "t"), raw_weather(spark)
    for run in ("a", "b"):
        files.append_raw(raw, at, WEATHER, run)
    read = files.read_raw(spark, at, WEATHER, ["b"]).inputFiles()
    assert read and all("/_run=b/" in f for f in read)


@pytest.mark.parametrize("step", ["write", "first", "second"])
def test_a_full_publish_that_fails_leaves_a_table(spark, tmp_path, monkeypatch, step):
    make = lambda x: spark.createDataFrame([("a", date(2024, 1, k), x) for k in (1, 2)], "city_id string, date date, x int")
    path, moved, plain = str(tmp_path / "h"), [], marks.move
    files.publish(make(1), path)

    def failing(*a):
        moved.append(a)
        if len(moved) == ("first", "second").index(step) + 1:
            raise OSError("lost")
        plain(*a)

    if step != "write":
        monkeypatch.setattr(marks, "move", failing)
    bad = make(2).withColumn("x", F.when(F.col("x") == 2, F.raise_error("lost").cast("int"))) if step == "write" else make(2)
    with pytest.raises(Exception, match="lost"):
        files.publish(bad, path)
    monkeypatch.setattr(marks, "move", plain)
    files.recover(spark, path)
    assert [r["x"] for r in spark.read.parquet(path).collect()] == [1, 1]
    files.publish(make(3), path)
    assert [r["x"] for r in spark.read.parquet(path).collect()] == [3, 3] and not marks.exists(spark, f"{path}.before")


def test_rows_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1000).selectExpr("id", "date'2024-01-01' date").mapInArrow(counted, "id long, date date")
    files.publish(df, str(tmp_path / "t"))
    assert seen.value == 1000


@pytest.fixture
def stored(spark, tmp_path):
    """A published history without some rows, and what is needed to refresh it."""
    raw = fixtures.raw_tables(spark, SF)
    return raw, fixtures.normals_of(raw), (raw.weather, raw.air, raw.river, raw.observed), str(tmp_path / "history")


def day_of(f):
    return F.to_date("valid_ts_utc") if "valid_ts_utc" in f.columns else F.col("date")


CASES = {
    "a tenth of the rows": lambda d: F.col("event_id") % 10 == 0,
    "one site": lambda d: F.col("city_id") == "site_7",
    "first and last days": lambda d: d.isin(date(2024, 1, 1), date(2024, 1, 30)) & (F.col("city_id") != "site_1"),
    "a middle day": lambda d: (d == date(2024, 1, 15)) & F.col("city_id").isin("site_2", "site_5"),
    "days far apart": lambda d: d.isin(date(2024, 1, 3), date(2024, 1, 4), date(2024, 1, 27)) & F.col("city_id").isin("site_3", "site_9"),
}


@pytest.mark.parametrize(("case", "reach"), [("a tenth of the rows", 7), ("one site", 1), ("first and last days", 0), ("a middle day", 7), ("days far apart", 0)])
def test_a_refresh_equals_a_rebuild(spark, stored, case, reach):
    _, normals, feeds, path = stored
    late = CASES[case]
    files.publish(scoring.risk_history(plans.panel_of(*(f.where(~late(day_of(f))) for f in feeds)), normals), path)
    changed = feeds[0].where(late(day_of(feeds[0]))).select("city_id", day_of(feeds[0]).alias("date"))
    for f in feeds[1:]:
        changed = changed.union(f.where(late(day_of(f))).select("city_id", day_of(f).alias("date")))
    plans.refresh_published(spark, path, feeds, changed, normals, reach=reach)
    want = scoring.risk_history(plans.panel_of(*feeds), normals)
    assert same(spark.read.parquet(path), want)
    if reach == 0:
        plans.refresh_published(spark, path, feeds, changed, normals, reach=reach)  # the same again
        assert same(spark.read.parquet(path), want)


def test_a_refresh_follows_rows_that_leave(spark, stored, reach=0):
    _, normals, feeds, path = stored
    days = [date(2024, 1, 7), date(2024, 1, 8), date(2024, 1, 20)]
    gone = lambda f: day_of(f).isin(days) & F.col("city_id").isin("site_2", "site_5") | (day_of(f) == date(2024, 1, 12))
    files.publish(scoring.risk_history(plans.panel_of(*feeds), normals), path)
    changed = feeds[0].where(gone(feeds[0])).select("city_id", day_of(feeds[0]).alias("date"))
    now = tuple(f.where(~gone(f)) for f in feeds)
    plans.refresh_published(spark, path, now, changed, normals, reach=reach)
    assert same(spark.read.parquet(path), scoring.risk_history(plans.panel_of(*now), normals))
    assert not marks.exists(spark, f"{path}/date=2024-01-12")


def test_only_affected_days_are_written(spark, stored):
    _, normals, feeds, path = stored
    files.publish(scoring.risk_history(plans.panel_of(*feeds), normals), path)
    before = {d: marks.names(spark, f"{path}/date={d}") for d in plans._stored_days(spark, path)}
    plans.refresh_published(spark, path, feeds, spark.createDataFrame([("site_3", date(2024, 1, 15))], "city_id string, date date"), normals)
    changed = {d for d, n in before.items() if marks.names(spark, f"{path}/date={d}") != n}
    assert changed == {date(2024, 1, 14), date(2024, 1, 15)}
    plans.refresh_published(spark, path, feeds, spark.createDataFrame([], "city_id string, date date"), normals)


def test_runs_are_taken_up_once_and_a_failed_refresh_is_repeated(spark, stored, tmp_path, monkeypatch):
    raw, normals, _, path = stored
    at = {f.name: str(tmp_path / f.name) for f in (WEATHER, AIR, RIVER, OBSERVED)}
    tables = ((WEATHER, raw.weather), (AIR, raw.air), (RIVER, raw.river), (OBSERVED, raw.observed))

    def load(run, cond):
        for feed, rows in tables:
            files.append_raw(rows.where(cond), at[feed.name], feed, run)

    load("r1", "event_id % 4 != 0")
    assert len(plans.refresh_runs(spark, path, at, normals)) == 4 and plans.refresh_runs(spark, path, at, normals) == []
    load("r2", "event_id % 4 = 0 and event_id % 8 != 0")
    plain = marks.put
    monkeypatch.setattr(marks, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        plans.refresh_runs(spark, path, at, normals)
    monkeypatch.setattr(marks, "put", plain)
    load("r3", "event_id % 8 = 0")
    assert set(plans.refresh_runs(spark, path, at, normals)) == {f"{n}/{r}" for n in at for r in ("r2", "r3")}
    assert same(spark.read.parquet(path), scoring.risk_history(plans.panel_of(raw.weather, raw.air, raw.river, raw.observed), normals))


def test_days_are_moved_by_dates_not_by_rows(spark, tmp_path):
    """A site with a gap of a year: its neighbours lie outside of the reach."""
    weather = "ingestion_run_id string, ingested_at_utc timestamp, city_id string, valid_ts_utc timestamp_ntz, temperature_2m double, precipitation_mm double, wind_speed_10m double, wind_gusts_10m double, weather_code long"
    first = date(2023, 1, 1)
    rows = [("a", first + timedelta(k), float(k)) for k in (0, 1, 2, 180, 400, 401)] + [("b", first + timedelta(k), 1.0) for k in range(0, 402, 40)]
    make = lambda rs: spark.createDataFrame([(c, d.isoformat(), t) for c, d, t in rs], "c string, d string, t double").selectExpr("'r' ingestion_run_id", "timestamp'2024-01-01' ingested_at_utc", "c city_id", "cast(d as timestamp_ntz) valid_ts_utc", "t temperature_2m", "0.0D precipitation_mm", "0.0D wind_speed_10m", "0.0D wind_gusts_10m", "1L weather_code")
    assert make(rows).schema.simpleString().replace(" ", "")[7:-1].split(",")[0] == weather.split(",")[0].replace(" ", ":")
    raw = fixtures.raw_tables(spark, SF)
    rest = (raw.air.limit(0), raw.river.limit(0), raw.observed.limit(0))
    normals = spark.createDataFrame([("a", 1, 0.0)], "city_id string, month int, normal_temperature_2m_max double")
    path = str(tmp_path / "h")
    files.publish(scoring.risk_history(plans.panel_of(make([r for r in rows if r[:2] != ("a", first + timedelta(180))]), *rest), normals), path)
    plans.refresh_published(spark, path, (make(rows), *rest), spark.createDataFrame([("a", first + timedelta(180))], "city_id string, date date"), normals, reach=3)
    assert same(spark.read.parquet(path), scoring.risk_history(plans.panel_of(make(rows), *rest), normals))
