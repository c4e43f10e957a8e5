"""Streams into stored tables: bounded commits, replays, and a history that follows."""

from datetime import datetime

import pytest

from gaugeline import fixtures, plans, streaming
from gaugeline.operators import scoring
from gaugeline.operators.staging import latest_weather
from gaugeline.sources import files, marks
from gaugeline.sources.feeds import AIR, OBSERVED, RIVER, WEATHER

SF = "/root/testdata/sf0.001"
KEYS = ["city_id", "valid_ts_utc"]


def test_commits_stay_bounded_and_a_batch_can_be_replayed_after_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "COMPACT", 4)
    target, most, rows = str(tmp_path / "t"), 0, []
    schema = "ingested_at_utc timestamp, city_id string, valid_ts_utc timestamp_ntz, x long"
    for k in range(14):
        rows.append((datetime(2024, 2, 1, k), f"c{k % 3}", datetime(2024, 1, 1 + k % 5), k))
        batch = spark.createDataFrame(rows[-1:], schema)
        for _ in range(2 if k in (4, 8, 9) else 1):  # replayed
            streaming.upsert(batch, k, target, KEYS, "valid_ts_utc")
        most = max(most, len(marks.names(spark, f"{target}/commits")))
    got = {(r["city_id"], r["valid_ts_utc"], r["x"]) for r in streaming.read_latest(spark, target, batch.schema).collect()}
    newest = {(r[1], r[2]): r for r in rows}
    assert got == {(c, t, r[3]) for (c, t), r in newest.items()} and most <= 2 * 4


def test_compaction_equals_no_compaction(spark, tmp_path, monkeypatch):
    raw = fixtures.raw_tables(spark, SF).weather
    raw.repartition(9, "event_id").write.parquet(str(tmp_path / "source"))
    for every in (2, 1000):
        monkeypatch.setattr(streaming, "COMPACT", every)
        streaming.stream_latest(spark, str(tmp_path / "source"), raw.schema, str(tmp_path / f"t{every}"), KEYS, "valid_ts_utc", str(tmp_path / f"c{every}"), 1).awaitTermination()
    a, b = (streaming.read_latest(spark, str(tmp_path / f"t{every}"), raw.schema).drop("_day") for every in (2, 1000))
    want = latest_weather(raw)
    for got in (a, b):
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert len(marks.names(spark, str(tmp_path / "t2/commits"))) <= 3 < len(marks.names(spark, str(tmp_path / "t1000/commits")))


@pytest.mark.parametrize("step", ["append", "refresh"])
def test_a_history_that_fails_midway_follows_when_the_batch_is_replayed(spark, tmp_path, monkeypatch, step):
    raw = fixtures.raw_tables(spark, SF)
    at = {f.name: str(tmp_path / f.name) for f in (WEATHER, AIR, RIVER, OBSERVED)}
    for feed, rows in ((WEATHER, raw.weather.where("event_id % 5 != 0")), (AIR, raw.air), (RIVER, raw.river), (OBSERVED, raw.observed)):
        files.append_raw(rows, at[feed.name], feed, "run-1")
    fixtures.normals_of(raw).write.parquet(str(tmp_path / "normals"))
    normals, history = spark.read.parquet(str(tmp_path / "normals")), str(tmp_path / "h")
    plans.refresh_runs(spark, history, at, normals)
    raw.weather.where("event_id % 5 = 0").select(WEATHER.raw_schema.fieldNames()).repartition(2, "city_id", "valid_ts_utc").write.parquet(str(tmp_path / "source"))
    start = lambda: streaming.stream_history(spark, str(tmp_path / "source"), WEATHER, at, history, normals, str(tmp_path / "c"), 1)
    name, plain = ("append_raw", streaming.append_raw) if step == "append" else ("refresh_runs", streaming.refresh_runs)
    calls = []

    def failing(*a):
        calls.append(a)
        if len(calls) == 2:
            if step == "append":
                files.write_run(a[0], *a[1:])
            raise OSError("lost")
        return plain(*a)

    monkeypatch.setattr(streaming, name, failing)
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    monkeypatch.setattr(streaming, name, plain)
    start().awaitTermination()
    got, want = spark.read.parquet(history), scoring.risk_history(plans.panel_of(raw.weather, raw.air, raw.river, raw.observed), normals)
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count()
    assert len(files.committed_runs(spark, at["weather"])) == 3
