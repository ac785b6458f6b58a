import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from headwise.functions import clock, geo, hashing, scoring
from headwise.params import bounded, parse_instant, window_seconds


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_residual_score_cases(spark):
    no_history = (F.lit(0), F.lit(None).cast("double"), F.lit(None).cast("double"))
    row = one(
        spark,
        by_scale=scoring.ssl_residual_score(F.lit(70.0), *no_history, F.lit(20.0)),
        small_scale=scoring.ssl_residual_score(F.lit(-1.75), *no_history, F.lit(0.1)),
        zero=scoring.ssl_residual_score(F.lit(0.0), F.lit(100), F.lit(1.0), F.lit(2.0), F.lit(5.0)),
        calibrated=scoring.ssl_residual_score(F.lit(-30.0), F.lit(64), F.lit(10.0), F.lit(50.0), F.lit(5.0)),
        spread_floor=scoring.ssl_residual_score(F.lit(10.5), F.lit(64), F.lit(10.0), F.lit(10.2), F.lit(5.0)),
    )
    assert row.by_scale == 1.0 and row.zero == 0.0
    assert row.small_scale == pytest.approx(0.5)
    assert row.calibrated == pytest.approx(0.5)
    assert row.spread_floor == pytest.approx(0.5)


def test_relative_and_composite(spark):
    row = one(
        spark,
        relative=scoring.relative_error(F.lit(60.0), F.lit(0.0)),
        composite=scoring.composite_score(F.lit(1.0), F.lit(0.5), F.lit(0.5)),
        missing=scoring.clip01(F.lit(None).cast("double")),
    )
    assert row.relative == 0.5 and row.composite == pytest.approx(0.75) and row.missing is None


def test_band_edges(spark):
    values = [float("nan"), None, -1.0, 0.35, 0.6, 0.85, 1.0, 2.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    bands = [r.b for r in df.orderBy("i").select(scoring.severity_band(F.col("v")).alias("b")).collect()]
    assert bands == ["low", "low", "low", "watch", "elevated", "critical", "critical", "critical"]


@pytest.mark.parametrize("utc, local", [
    ("2024-01-01 00:00:07.9", "2023-12-31T19:00:07-05:00"),
    ("2024-07-01 12:00:00", "2024-07-01T08:00:00-04:00"),
    ("2024-03-10 06:59:59", "2024-03-10T01:59:59-05:00"),
    ("2024-03-10 07:00:00", "2024-03-10T03:00:00-04:00"),
    ("2024-11-03 05:30:00", "2024-11-03T01:30:00-04:00"),
])
def test_local_time(spark, utc, local):
    ts = F.lit(utc).cast("timestamp")
    assert one(spark, t=clock.local_text(ts)).t == local


def test_ts_pack_truncates_and_keeps_null(spark):
    row = spark.range(1).select(
        *clock.ts_pack(F.lit("2024-01-01 00:00:07.179575").cast("timestamp"), "a"),
        *clock.ts_pack(F.lit(None).cast("timestamp"), "b"),
    ).first()
    assert row.a_ts_utc == "2024-01-01T00:00:07Z" and row.a_ts_epoch_ms == 1704067207179
    assert row.b_ts_utc is None and row.b_ts_epoch_ms is None and row.b_ts_ny is None


def test_hash_matches_python(spark):
    words = ["A", "", None, "R17N", "ünï"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.h for r in df.select(hashing.stable_hash_unit(F.col("w"), 997).alias("h")).collect()]
    want = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 997 / 997 if w else 0.0 for w in words]
    assert got == want


def test_fingerprint_is_one_two_level_digest(spark):
    ids = spark.range(500).select(F.col("id").cast("string").alias("i"))
    found = hashing.set_fingerprint(ids, "i").first()
    buckets = {}
    for text in sorted(str(i) for i in range(500)):
        buckets.setdefault(hashlib.md5(text.encode()).hexdigest()[:2], []).append(text)
    sha = lambda parts: hashlib.sha1(",".join(parts).encode()).hexdigest()
    assert found.fingerprint == sha(f"{b}:{sha(t)}" for b, t in sorted(buckets.items()))[:16] and found.n == 500
    assert hashing.set_fingerprint(ids.repartition(7), "i").first() == found
    assert hashing.set_fingerprint(ids.where("i <> '77'"), "i").first().fingerprint != found.fingerprint
    assert hashing.set_fingerprint(ids.limit(0), "i").first().n == 0


def test_geojson(spark):
    df = spark.sql("""
        select 's1' stop_id, cast(null as string) stop_name, 'A' route_id, -73.5D lon, 40.25D lat,
               cast(null as double) anomaly_score, cast(null as double) residual,
               cast(null as double) headway_sec, 120.0D predicted_headway_sec,
               'x' observed_ts_utc, 1L observed_ts_epoch_ms, 'y' observed_ts_ny,
               'u' event_ts_utc, 2L event_ts_epoch_ms, 'v' event_ts_ny, t event_ts
        from values (timestamp'2024-01-01'), (cast(null as timestamp)) as v(t)""")
    texts = [r.feature for r in geo.event_feature(df).collect()]
    assert sum('"event_ts_utc":"u"' in t for t in texts) == 1
    for t in texts:
        assert '"coordinates":[-73.5,40.25]' in t and '"headway_sec":null' in t
        assert '"anomaly_score":0.0' in t and '"stop_name":null' in t
    stations = geo.station_feature(df.select("stop_id", "stop_name", "lon", "lat").limit(1))
    document = geo.feature_collections(stations, F.lit("t0")).first().collection
    assert document.startswith('{"type":"FeatureCollection","timestamp":"t0","features":[{"type":"Feature"')


def test_tiles_hold_every_feature_once_and_stay_small(spark):
    # 300 stops around a city, 200 at one place, some far away, outside the map or without a place.
    places = [(-73.9 + (i % 20) * 0.01, 40.7 + (i // 20) * 0.01) for i in range(300)] + [(2.35, 48.85)] * 200
    places += [(180.0, 90.0), (-180.0, -90.0), (400.0, -400.0), (None, None), (151.2, -33.9)]
    rows = spark.createDataFrame([(f"s{i}", f"n{i}", *p) for i, p in enumerate(places)], "stop_id string, stop_name string, lon double, lat double")
    features = geo.station_feature(rows)
    tiled = geo.feature_tiles(features, limit=40).collect()
    assert sorted(r.stop_id for r in tiled) == sorted(f"s{i}" for i in range(len(places)))
    sizes = {}
    for r in tiled:
        sizes[r.tile_level, r.tile, r.part] = sizes.get((r.tile_level, r.tile, r.part), 0) + 1
    assert max(sizes.values()) <= 40
    # Only the crowded place is cut into parts; no two tiles of different depth overlap.
    assert {(r.lon, r.lat) for r in tiled if r.part} == {(2.35, 48.85)}
    tiles = {(level, tile) for level, tile, _ in sizes}
    assert not any((up, tile >> 2 * (level - up)) in tiles for level, tile in tiles for up in range(level))
    # A tile is the largest that fits: the cell around it holds more than the limit.
    for level, tile in tiles:
        around = sum(n for (deep, code, _), n in sizes.items() if deep >= level > 0 and code >> 2 * (deep - level + 1) == tile >> 2)
        assert level == 0 or around > 40
    documents = geo.feature_collections(features, F.lit("t0"), limit=40).collect()
    assert sum(len(json.loads(d.collection)["features"]) for d in documents) == len(places) == sum(d.n_features for d in documents)
    assert geo.feature_collections(features.limit(0), F.lit("t0")).count() == 0


def test_parameters():
    assert [window_seconds(w) for w in ("15m", " 2H ", "abc", "")] == [900, 7200, 900, 900]
    assert window_seconds("x", default_minutes=60) == 3600
    with pytest.raises(ValueError):
        window_seconds("xm")
    assert parse_instant("2024-01-01T00:00:00Z") == parse_instant("2024-01-01T00:00:00")
    assert parse_instant("now") is None
    with pytest.raises(ValueError):
        parse_instant("yesterday")
    with pytest.raises(ValueError):
        bounded("limit", 19, 20, 1000)


def test_cyclic_time(spark):
    row = spark.range(1).select(*clock.cyclic_time(F.lit("2024-01-01 06:15:00").cast("timestamp"))).first()
    assert row.hour_sin == pytest.approx(1) and row.minute_cos == pytest.approx(0, abs=1e-12)
    assert row.hour_sin ** 2 + row.hour_cos ** 2 == pytest.approx(1) and not math.isnan(row.minute_sin)
