import json
from datetime import date, datetime

import pytest

from gaugeline import fixtures
from gaugeline.operators import quality
from gaugeline.sources import feeds, files
from gaugeline.sources.payloads import parse_payload

SF = "/root/testdata/sf0.001"


def payload(times, **arrays):
    full = {p: [1.0] * len(times) for p, _, _ in feeds.WEATHER.measures} | {"weather_code": [3] * len(times)} | arrays
    return json.dumps({"hourly": {"time": times, **full}})


CASES = {
    "good": payload(["2024-01-01T00:00", "2024-01-01T01:00"], temperature_2m=[None, 2.5]),
    "long": payload(["2024-01-01T00:00"], temperature_2m=[1.0, 2.0, 3.0]),
    "short": payload(["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01T02:00"], precipitation=[1.0, 2.0]),
    "none": payload([]),
    "json": "{",
    "null": None,
    "root": '{"daily": {"time": []}}',
    "time": payload(["yesterday"]),
}


def test_payloads(spark):
    rows, errors = parse_payload(spark.createDataFrame(list(CASES.items()), "city_id string, payload string"), feeds.WEATHER)
    got = {(r["city_id"], r["payload_pos"]): r for r in rows.collect()}
    assert set(got) == {("good", 0), ("good", 1), ("long", 0)}
    assert got["good", 0]["temperature_2m"] is None and got["good", 1]["valid_ts_utc"] == datetime(2024, 1, 1, 1)
    assert {r["city_id"]: r["reason"] for r in errors.collect()} == {"short": "short_array", "json": "corrupt_json", "null": "corrupt_json", "root": "missing_time", "time": "bad_time"}


@pytest.mark.parametrize("name", list(fixtures.FEED_OF))
def test_rows_to_payloads_and_back(spark, name):
    table, feed = fixtures.FEED_OF[name]
    raw = getattr(fixtures.raw_tables(spark, SF), table)
    back = parse_payload(fixtures.payloads(raw, feed), feed)[0]
    columns = ["city_id", "ingestion_run_id", feed.time_column, *feed.columns]
    assert back.select(columns).exceptAll(raw.select(columns)).count() == 0 and back.count() == raw.count()


def test_append_read_and_required(spark, tmp_path):
    rows, _ = parse_payload(spark.createDataFrame([("a", CASES["good"]), (None, CASES["long"])], "city_id string, payload string"), feeds.WEATHER)
    good, bad = files.split_required(files.stamp(rows, "r1", datetime(2024, 1, 1)), feeds.WEATHER)
    assert [r["reason"] for r in bad.collect()] == ["missing_required"]
    for _ in range(2):
        files.append_raw(good, str(tmp_path / "t"), feeds.WEATHER)
    raw = files.read_raw(spark, str(tmp_path / "t"), feeds.WEATHER)
    assert raw.count() == 4 and raw.where("_day = date'2024-01-01'").count() == 4


def test_publish_replaces_only_changed_dates(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "city_id string, date date, x int")
    path = str(tmp_path / "h")
    files.publish(make([("a", date(2024, 1, 1), 1), ("a", date(2024, 1, 2), 2)]), path)
    files.publish(make([("a", date(2024, 1, 2), 9)]), path, "changed")
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == [1, 9]
    files.publish(make([("a", date(2024, 1, 3), 3)]), path)
    assert [r["x"] for r in spark.read.parquet(path).collect()] == [3]


def test_dimension_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("city_id,city_name,country_code,latitude,longitude,timezone,region,active,river_enabled,display_order\na,A,XX,1.5,2,UTC,R,TRUE,True,1\nb,B,XX,1,2,UTC,R,false,true,2\nc,C,XX,1,2,UTC,R,true,,3\n")
    assert {r["city_id"]: r["river_enabled"] for r in files.sites(spark, str(tmp_path / "s.csv")).collect()} == {"a": True, "c": False}
    (tmp_path / "n.csv").write_text("city_id,month,normal_temperature_2m_mean,normal_temperature_2m_max,normal_daily_precipitation_mm,normal_wind_speed_10m_max\na,1,1.5,2.5,3,4\n")
    assert files.normals(spark, str(tmp_path / "n.csv")).first()["normal_temperature_2m_max"] == 2.5


def test_run_status(spark):
    runs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "ingestion_run_id string")
    out = {r["ingestion_run_id"]: r["status"] for r in quality.run_summary({"weather": runs("a", "b", "b"), "flood": runs("a")}, runs("b", "c")).collect()}
    assert out == {"a": "success", "b": "partial_failure", "c": "failure"}


def test_a_filter_on_day_prunes_the_scan(spark, tmp_path):
    raw = fixtures.raw_tables(spark, SF).weather
    files.append_raw(raw, str(tmp_path / "raw"), feeds.WEATHER)
    df = files.read_raw(spark, str(tmp_path / "raw"), feeds.WEATHER).where("_day = date'2024-01-05' and city_id = 'site_3'").select("temperature_2m")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_day" in plan and "PushedFilters: [IsNotNull(city_id), EqualTo(city_id,site_3)]" in plan
    assert "ReadSchema: struct<city_id:string,temperature_2m:double>" in plan
    assert df.count() == raw.where("to_date(valid_ts_utc) = date'2024-01-05' and city_id = 'site_3'").count()


def test_large_days_are_written_in_several_files(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "date'2024-01-01' + cast(id % 20 > 18 as int) date", "cast(null as date) d")
    files.publish(df, str(tmp_path / "t"), rows_per_file=100)
    counts = [len(list((tmp_path / "t" / f"date=2024-01-0{d}").glob("*.parquet"))) for d in (1, 2)]
    assert counts[0] >= 3 and counts[1] == 1 and spark.read.parquet(str(tmp_path / "t")).count() == 1000
    assert files.by_day(df, "d").count() == 1000


def test_runs_have_ids_of_their_own():
    a, b = files.new_run(), files.new_run()
    assert a[0] != b[0] and a[1].utcoffset().total_seconds() == 0 and a[0].startswith(f"{a[1]:%Y%m%dT%H%M%SZ}")


@pytest.mark.parametrize("at", ["before", "after"])
def test_a_stream_that_fails_midway_is_replayed_to_the_same_table(spark, tmp_path, monkeypatch, at):
    from gaugeline import streaming
    from gaugeline.operators.staging import latest_weather

    raw, top = fixtures.raw_tables(spark, SF).weather, str(tmp_path)
    raw.repartition(4, "event_id").write.parquet(f"{top}/source")
    start = lambda: streaming.stream_latest(spark, f"{top}/source", raw.schema, f"{top}/target", ["city_id", "valid_ts_utc"], "valid_ts_utc", f"{top}/checkpoint", 1)
    plain_commit = streaming.commit

    def failing(session, target, batch_id, days):
        if at == "after":
            plain_commit(session, target, batch_id, days)
        if batch_id == 2:
            raise OSError("lost")
        if at == "before":
            plain_commit(session, target, batch_id, days)

    monkeypatch.setattr(streaming, "commit", failing)
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    monkeypatch.setattr(streaming, "commit", plain_commit)
    start().awaitTermination()
    got, want = streaming.read_latest(spark, f"{top}/target", raw.schema).drop("_day"), latest_weather(raw)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
