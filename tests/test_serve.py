import json
from datetime import timedelta

import pytest

from headwise.plans import serve
from tests.conftest import START


@pytest.fixture
def stops(spark):
    return spark.createDataFrame([("s1", "One", 40.5, -73.5)], "stop_id string, stop_name string, lat double, lon double")


def test_summary_of_empty_table(scores):
    row = serve.summary(scores([]), as_of=START).first()
    assert (row.scored_rows, row.stations_total, row.trains_active, row.anomaly_rate_perc) == (0, 0, 0, 0.0)
    assert row.last_updated_utc == "2024-01-01T00:00:00Z" and row.last_updated_ny == "2023-12-31T19:00:00-05:00"


def test_summary_counts(scores):
    scored = {"predicted_headway_sec": 90.0}
    rows = scores([
        {**scored, "anomaly_score": 0.85}, {**scored, "anomaly_score": 0.60, "stop_id": "s2"},
        {**scored, "anomaly_score": 0.59, "headway_sec": 0.0, "stop_id": "s3"}, {"anomaly_score": 0.9},
        {**scored, "anomaly_score": 1.0, "observed_ts": START - timedelta(hours=1), "stop_id": "old"},
    ])
    row = serve.summary(rows, "15m").first()
    assert (row.scored_rows, row.stations_total, row.trains_active) == (3, 3, 2)
    assert (row.anomalies_count, row.anomalies_high, row.anomaly_rate_perc) == (2, 1, 66.67)
    # Looking back from later on, the window is empty but the last update is not.
    later = serve.summary(rows, "15m", as_of=START + timedelta(days=1)).first()
    assert later.scored_rows == 0 and later.last_updated_utc == "2024-01-01T00:00:03Z"


def test_anomalies(scores, stops):
    rows = scores([
        {"predicted_headway_sec": 1.0, "anomaly_score": s, "route_id": r, "stop_id": p, "event_ts": START if s > 0.5 else None}
        for s, r, p in ((0.9, "A", "s1"), (0.2, "A", "x"), (0.7, "B", "s1"))
    ])
    got = serve.anomalies(rows, stops, route_id="all").collect()
    assert [(r.anomaly_score, r.stop_name) for r in got] == [(0.9, "One"), (0.7, "One"), (0.2, None)]
    assert got[2].event_ts_utc is None and got[0].event_ts_utc == "2024-01-01T00:00:00Z"
    assert [r.route_id for r in serve.anomalies(rows, stops, route_id="B").collect()] == ["B"]
    assert serve.anomalies(rows, stops, min_score=0.7).count() == 2
    with pytest.raises(ValueError):
        serve.anomalies(rows, stops, limit=5)


def test_heatmap_is_closed_and_located(scores, stops):
    rows = scores([
        {"predicted_headway_sec": 1.0, "anomaly_score": 0.3},
        {"predicted_headway_sec": 1.0, "anomaly_score": 0.8, "observed_ts": START + timedelta(hours=2)},
        {"predicted_headway_sec": 1.0, "anomaly_score": 0.9, "stop_id": "unknown"},
    ])
    got = serve.heatmap(rows, stops, as_of=START + timedelta(hours=1)).collect()
    assert [(r.stop_id, r.anomaly_score) for r in got] == [("s1", 0.3)]
    feature = json.loads(got[0].feature)
    assert feature["geometry"]["coordinates"] == [-73.5, 40.5]
    assert "event_ts_utc" not in feature["properties"] and feature["properties"]["residual"] == 0.0


def test_freshness(scores, stops, spark):
    rows = scores([{}])
    fresh = serve.freshness(rows, stops, START + timedelta(seconds=900)).first()
    assert (fresh.status, fresh.last_observed_age_sec, fresh.scores_recent_15m) == ("ok", 900, 1)
    stale = serve.freshness(rows, stops, START + timedelta(seconds=901)).first()
    assert (stale.status, stale.fresh) == ("degraded", False)
    assert serve.freshness(rows, stops.limit(0), START).first().status == "degraded"
    document = lambda status: spark.createDataFrame([(status, 5)], "status string, rows_seen long")
    assert serve.freshness(rows, stops, START, model=document("error")).first().status == "degraded"
    told = serve.freshness(rows, stops, START, model=document("available"), shadow=document("unavailable")).first()
    assert (told.status, told.model_status, told.shadow_status) == ("ok", "available", "unavailable")
    assert (told.model_telemetry, told.shadow_telemetry) == ('{"rows_seen":5}', None)
    empty = serve.freshness(scores([]), stops, START).first()
    assert (empty.status, empty.scores_total, empty.last_observed_age_sec, empty.fresh) == ("degraded", 0, None, False)


def test_features_and_sample(scores):
    rows = scores([{"headway_sec": h, "predicted_headway_sec": 5.0} for h in (60.0, 120.0, 600.0, -1.0, None)])
    got = serve.features_batch(rows).collect()
    assert sorted(r.headway_sec for r in got) == [60.0, 120.0, 600.0]
    assert {(r["median"], r["mad"]) for r in got} == {(120.0, 60.0)}
    assert serve.shadow_sample(rows).count() == 4


def test_routes_fingerprint(scores, spark):
    static = spark.createDataFrame([("Z",)], "route_id string")
    rows = scores([{"route_id": r} for r in "BAB"])
    assert [r[0] for r in serve.routes(rows, static).collect()] == ["A", "B"]
    assert serve.routes_fingerprint(rows, static).first().n == 2
