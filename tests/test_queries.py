"""Queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

from pulsegrid.operators import clusters
from pulsegrid.plans import oracles, views
from pulsegrid.plans.queries import QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return [plain(x) for x in v] if isinstance(v, list) else v


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((repr([plain(v) for v in r]) for r in frame[cols].itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(oracles.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracles.SQL)))
def test_runs(spark, name):
    frame = QUERIES[name](spark, SF).toPandas()
    assert len(frame.columns) > 1


def test_every_oracle_has_a_query():
    assert set(oracles.SQL) <= set(QUERIES)


def test_signals_of_event_types_are_whole(spark, duck):
    want = dict(duck.execute("select event_type, count(value) from events group by event_type").fetchall())
    got = {r["signal_id"]: r["count"] for r in views.sig_type(spark, SF).groupBy("signal_id").count().collect()}
    assert got == want and len(set(want.values())) > 1


def test_kmeans_query_has_all_starts(spark, monkeypatch):
    fits, fit = [], clusters.KMeans.fit
    monkeypatch.setattr(clusters.KMeans, "fit", lambda self, data: fits.append(self.getSeed()) or fit(self, data))
    QUERIES["kmeans"](spark, SF)
    assert len(set(fits)) == 10


def test_recordings_follow_the_events(spark, duck):
    users = dict(duck.execute("select user_id, count(*) from events group by user_id").fetchall())
    n = {r["signal_id"]: r["count"] for r in views.recordings(spark, SF, 250.0).groupBy("signal_id").count().collect()}
    assert n.keys() == users.keys()
    # A beat at 250 Hz has about 200 samples.
    assert all(150 < n[k] / users[k] < 260 for k in users)
    found = {r["signal_id"] for r in QUERIES["detect_hamilton"](spark, SF).select("signal_id").distinct().collect()}
    assert found == users.keys()
