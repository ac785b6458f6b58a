import json
import zipfile
from datetime import timedelta

import pytest
from pyspark.sql import functions as F, types as T

from headwise.schema import SNAPSHOT
from headwise.sources import feeds, model_state, scores as scores_io, static_files, telemetry
from tests.conftest import START


def snapshot(feed, *entities):
    return (feed, START, list(entities))


def trip(route, *updates):
    time = lambda t: None if t is None else (t,)
    return (((route,), [(stop, time(a), time(d)) for stop, a, d in updates]), None)


def vehicle(route, stop, t):
    return (None, ((route,), stop, t))


def test_flatten_rules(spark):
    rows = spark.createDataFrame([
        snapshot("ACE", trip("A", ("s1", 100, 200), ("s2", 0, 200), ("s3", None, None), ("", 5, 5), ("s4", None, 0))),
        snapshot("L", trip("", ("s1", 100, 200)), vehicle("L", "v1", 300), vehicle("L", "v2", 0), vehicle("L", "", 9)),
        snapshot("G", trip("G")),
    ], SNAPSHOT)
    got = sorted((r.feed, r.route_id, r.stop_id, r.arrival) for r in feeds.feed_flatten(rows).collect())
    assert got == [("ACE", "A", "s1", 100), ("ACE", "A", "s2", 200), ("L", "L", "v1", 300)]


def test_landing_skips_corrupt_snapshots(spark, tmp_path):
    good = json.dumps({"poll_ts": "2024-01-01T00:00:00.000Z", "entity": [
        {"vehicle": {"trip": {"route_id": "A"}, "stop_id": "s", "timestamp": 7}}]})
    for feed, lines in (("ACE", [good, good[:30]]), ("L", ["not json"]), ("G", [])):
        folder = tmp_path / f"feed={feed}"
        folder.mkdir()
        (folder / "part.json").write_text("\n".join(lines))
    rows = feeds.feed_flatten(feeds.feed_union(spark, str(tmp_path))).collect()
    assert [(r.feed, r.route_id, r.arrival) for r in rows] == [("ACE", "A", 7)]


STOPS = """stop_id,stop_name,stop_lat,stop_lon
 a1 ,One,40.5,-73.5
a2,Two,bad,-73
a2,Two,40,-73
,None,1,2
a1,Again,1,1
"a,3","The ""Hub"", x", 41 ,-74
"""
# The same stops with more columns, in another order, and a name on two lines.
MORE = """location_type,stop_lon,stop_lat,stop_name,parent_station,stop_id
0,-73.5,40.5,One,, a1 
0,-73,bad,Two,p,a2
0,-73,40,Two,p,a2
0,2,1,None,,
0,1,1,"Again
and again",,a1
1,-74, 41 ,"The ""Hub"", x",,"a,3"
"""


def zip_or_file(tmp_path, zipped, name, text):
    path = tmp_path / (f"{name}.zip" if zipped else name)
    if zipped:
        with zipfile.ZipFile(path, "w") as archive:
            archive.writestr(f"gtfs/{name}", text)
    else:
        path.write_text(text)
    return str(path)


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize("text", [STOPS, MORE])
def test_stops_files(spark, tmp_path, zipped, text):
    rows = {r.stop_id: r for r in static_files.stops_load(spark, zip_or_file(tmp_path, zipped, "stops.txt", text)).collect()}
    assert set(rows) == {"a1", "a,3"}
    assert (rows["a1"].stop_name, rows["a1"].lat, rows["a1"].routes) == ("One", 40.5, [])
    assert (rows["a,3"].stop_name, rows["a,3"].lat) == ('The "Hub", x', 41.0)


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize("text", ["route_id\n B \nA\n  \nA\n", "agency_id,route_id,route_type\nx, B ,1\nx,A,2\nx,  ,3\nx,A,4\n"])
def test_routes_files(spark, tmp_path, zipped, text):
    routes = static_files.routes_static_load(spark, zip_or_file(tmp_path, zipped, "routes.txt", text))
    assert [r.route_id for r in routes.collect()] == ["A", "B"]


@pytest.mark.parametrize("zipped", [False, True])
def test_missing_columns_are_null(spark, tmp_path, zipped):
    path = zip_or_file(tmp_path, zipped, "stops.txt", "stop_lon,stop_id,stop_lat\n1,a,2\n")
    row = static_files.stops_load(spark, path).first()
    assert (row.stop_id, row.stop_name, row.lat, row.lon) == ("a", "", 2.0, 1.0)


def test_telemetry_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    assert telemetry.telemetry_read(spark, path).first().status == "unavailable"
    row = spark.sql("select 123L rows_seen, 120L rows_updated, 2L drift_events, 14.7D mae_ema, 'now' last_run_utc, 1 other")
    telemetry.telemetry_write(row, path)
    got = telemetry.telemetry_read(spark, path).first()
    assert (got.status, got.rows_seen, got.rows_updated, got.drift_events, got.mae_ema, got.last_run_utc) == (
        "available", 123, 120, 2, 14.7, "now")
    assert got.residual_q90 is None and "other" not in got
    assert json.loads(telemetry.telemetry_read_all(spark, path).first().document)["other"] == 1
    assert telemetry.shadow_health_read(spark, path).first().last_run_utc == "now"


@pytest.mark.parametrize("text, status", [("{", "error"), ("[1]", "unavailable"), ("3", "unavailable"), ("{}", "available")])
def test_telemetry_status(spark, tmp_path, text, status):
    path = tmp_path / "doc.json"
    path.write_text(text)
    assert telemetry.telemetry_read(spark, str(path)).first().status == status


def test_append_is_idempotent_and_prunes(spark, scores, tmp_path):
    path = str(tmp_path / "scores")
    rows = scores([{"observed_ts": START + timedelta(hours=6 * i)} for i in range(12)])
    scores_io.append_scores(rows, path, batch_id=1)
    scores_io.append_scores(rows, path, batch_id=1)
    scores_io.append_scores(rows.withColumn("id", F.col("id") + 100), path, batch_id=2)
    assert scores_io.read_scores(spark, path).count() == 24


def test_rewrite_touches_only_its_dates(spark, scores, tmp_path):
    path = str(tmp_path / "scores")
    scores_io.append_scores(scores([
        {"observed_ts": START + timedelta(days=i), "window_sec": w} for i, w in enumerate((0, None, 120, 300))
    ]), path)
    untouched = {p for p in (tmp_path / "scores" / "observed_date=2024-01-04").rglob("*.parquet")}
    fresh = spark.createDataFrame(
        [(i, START + timedelta(days=min(i, 2)), 90.0, 10.0, 0.5) for i in (0, 1, 2, 99)],
        "id long, observed_ts timestamp, predicted_headway_sec double, residual double, anomaly_score double",
    )
    for _ in range(2):
        scores_io.rewrite_scores(spark, path, fresh)
        rows = {r.id: r for r in scores_io.read_scores(spark, path).collect()}
        assert sorted(rows) == [0, 1, 2, 3]
        assert [rows[i].window_sec for i in range(4)] == [300, 300, 120, 300]
        assert [rows[i].predicted_headway_sec for i in range(4)] == [90.0, 90.0, 90.0, None]
    assert untouched == {p for p in (tmp_path / "scores" / "observed_date=2024-01-04").rglob("*.parquet")}


def test_state_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert model_state.load_state(spark, path).count() == 0
    assert model_state.load_weights(spark, path) is None
    make = lambda n: spark.createDataFrame([("A", n, 1.0, 0, "{}")], model_state.STATE)
    tail = T.StructType([T.StructField("seq", T.LongType())])
    for n, version in ((2, "20240102"), (1, "20240101")):
        model_state.save_state(make(n), spark.createDataFrame([(n,)], tail), path, version)
    assert [r.rows_seen for r in model_state.load_state(spark, path).collect()] == [2]
    assert [r.seq for r in model_state.load_tail(spark, path, tail).collect()] == [2]
    assert [r.rows_seen for r in model_state.load_state(spark, path, before="20240102").collect()] == [1]
    model_state.save_weights(spark, [0.5, 1.5], str(tmp_path / "w"), "1")
    assert model_state.load_weights(spark, str(tmp_path / "w")) == [0.5, 1.5]


def test_corrupt_state_is_tolerated(spark, tmp_path):
    folder = tmp_path / "state" / "states" / "version=1"
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_bytes(b"garbage that is no parquet file")
    assert model_state.load_state(spark, str(tmp_path / "state")).count() == 0
