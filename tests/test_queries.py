"""Every registered query with SQL against that SQL, and the properties of the composed plans."""

import glob
import os
from datetime import date

import duckdb
import pytest

from gaugeline import oracle, plans
from gaugeline.fixtures import normals_of, raw_tables
from gaugeline.operators import current, scoring, staging
from gaugeline.queries import AS_OF, models, queries
from gaugeline.sources import files
from gaugeline.sources.feeds import WEATHER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_every_query_has_sql():
    assert set(queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", list(queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    found = duck.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(map(repr, (tuple(r[names.index(c)] for c in columns) for r in found.fetchall())))


def test_fixture_breaks_not_null_as_intended(spark):
    rows = {(r["model"], r["column"], r["check"]): r["violations"] for r in queries()["quality_report"](spark, SF).collect()}
    assert len(rows) == 22 and rows["risk_history", "global_tipping_score", "not_null"] == 26


def test_histogram_rank_equals_window_rank(spark):
    h = models(spark, SF, n_sites=150)["risk_history"]
    a, b = (current.risk_current(h, AS_OF, 20, rank=k).select("city_id", "rank") for k in ("window", "histogram"))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() > 10


def test_scores_are_bounded_and_overall_is_the_largest(spark):
    rows = models(spark, SF)["risk_history"].collect()
    for r in rows:
        factors = [r[f] for f in scoring.FACTORS]
        assert all(f is None or 0 <= f <= 100 for f in factors)
        assert r["global_tipping_score"] == (None if None in factors else max(factors))


def test_a_repeated_run_changes_nothing(spark):
    raw, normals = raw_tables(spark, SF), None
    normals = normals_of(raw)
    feeds = (raw.weather, raw.air, raw.river, raw.observed)
    once = scoring.risk_history(plans.panel_of(*feeds), normals)
    twice = scoring.risk_history(plans.panel_of(*(f.union(f) for f in feeds)), normals)
    assert once.exceptAll(twice).count() == 0 and once.count() == twice.count()


def test_site_filter_reaches_the_scan(spark, tmp_path):
    files.append_raw(raw_tables(spark, SF).weather, str(tmp_path / "raw"), WEATHER)
    df = staging.latest_weather(files.read_raw(spark, str(tmp_path / "raw"), WEATHER)).where("city_id = 'site_3'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan
    assert "EqualTo(city_id,site_3)" in plan[plan.index("PushedFilters") :]


def test_as_of_defaults_to_today(spark):
    assert current.risk_current(models(spark, SF)["risk_history"]).count() == 0
    assert date(2024, 1, 15) == AS_OF


def test_zone_summary_does_without_ranks(spark):
    m = models(spark, SF)
    runs = {}
    for k in ("zone_summary", "risk_current"):
        m[k].collect()
        plan = m[k]._jdf.queryExecution().executedPlan().toString()
        runs[k] = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert "rank#" not in runs["zone_summary"].replace("rank_", "")
    assert runs["zone_summary"].count("FileScan") <= runs["risk_current"].count("FileScan")
    assert "ReusedExchange" in runs["zone_summary"]


def test_refresh_follows_dates_that_leave_and_new_sites(spark):
    raw = raw_tables(spark, SF)
    feeds, normals = (raw.weather, raw.air, raw.river, raw.observed), normals_of(raw)
    gone = "city_id in ('site_2', 'site_5') and to_date({t}) in (date'2024-01-07', date'2024-01-08')"
    new = "city_id = 'site_7'"
    cut = lambda f, cond: f.where(f"not ({cond.format(t='valid_ts_utc' if 'valid_ts_utc' in f.columns else 'date')})")
    before = scoring.risk_history(plans.panel_of(*(cut(f, new) for f in feeds)), normals)
    now = tuple(cut(f, gone) for f in feeds)
    keys = [f.where(f"{new} or ({gone})".format(t=t)).selectExpr("city_id", f"to_date({t}) date") for f in feeds for t in ["valid_ts_utc" if "valid_ts_utc" in f.columns else "date"]]
    changed = keys[0].union(keys[1]).union(keys[2]).union(keys[3])
    got, want = plans.refresh_history(before, now, changed, normals), scoring.risk_history(plans.panel_of(*now), normals)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() == want.count()
    none = plans.refresh_history(want, now, changed.limit(0), normals)
    assert none.exceptAll(want).count() == 0 and none.count() == want.count()
