import time
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwise.operators import aggregates, filters, online, windows
from headwise.sources import feeds, scores as scores_io
from headwise.streaming import headways, ingest, runs, scoring, summaries
from tests.conftest import START


def write_parts(df, path, parts, key):
    """One file per part, in order, so that a rate-limited stream takes them in turn."""
    for i in range(parts):
        df.where(F.col(key) % parts == i).coalesce(1).write.mode("append").parquet(path)


def polls(spark, n=40):
    rng = np.random.default_rng(8)
    rows, eta = [], {}
    for p in range(n):
        at = START + timedelta(seconds=30 * p)
        for k in range(6):
            key = (f"R{k % 2}", f"s{k % 3}")
            eta[key] = eta.get(key, int(at.timestamp())) + int(rng.integers(-20, 90))
            rows += [(p, at, "ACE" if k % 2 else "L", *key, eta[key]), (p, at, "ACE" if k % 2 else "L", *key, eta[key] + 9)]
    return spark.createDataFrame(
        rows, "poll int, poll_ts timestamp, feed string, route_id string, stop_id string, arrival long")


def test_headways_in_micro_batches_equal_the_batch(spark, tmp_path):
    rows = polls(spark)
    path = str(tmp_path / "arrivals")
    # Consecutive polls per file: four files, four micro-batches.
    for i in range(4):
        rows.where((F.col("poll") >= 10 * i) & (F.col("poll") < 10 * i + 10)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path).drop("poll")
    columns = ["poll_ts", "feed", "route_id", "stop_id", "arrival", "prev_arrival", "headway_sec"]
    got = runs.drain(headways.stream_headway(stream), "t-headway").select(*columns).toPandas()
    want = windows.headway_lag(
        aggregates.earliest_arrival(filters.arrival_horizon_filter(rows.drop("poll")))).select(*columns).toPandas()
    order = ["poll_ts", "feed", "route_id", "stop_id"]
    got, want = (d.sort_values(order, ignore_index=True).astype({"prev_arrival": float}) for d in (got, want))
    assert len(got) == len(want) and got.equals(want)


def raw_scores(scores, n=1500):
    rng = np.random.default_rng(9)
    return scores([
        {"route_id": "AB"[int(rng.integers(2))], "stop_id": f"s{i % 7}", "headway_sec": float(rng.gamma(2, 150)),
         "observed_ts": START + timedelta(seconds=20 * i)} for i in range(n)
    ])


def test_scores_in_micro_batches_equal_the_batch(spark, scores, tmp_path):
    rows = raw_scores(scores).cache()
    path = str(tmp_path / "raw")
    for i in range(3):
        rows.where((F.col("id") >= 500 * i) & (F.col("id") < 500 * i + 500)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    runs.drain_batches(stream, scoring.stream_score(state, scoring.to_folder(out)), "t-score")
    got = spark.read.parquet(out).toPandas().sort_values("id", ignore_index=True)
    assert got["batch_id"].nunique() == 3
    want = online.score_online(rows).toPandas().sort_values("id", ignore_index=True)
    assert got["id"].tolist() == want["id"].tolist()
    for column in ("seq", "predicted_headway_sec", "residual", "ema", "tree_score", "anomaly_score"):
        np.testing.assert_allclose(got[column], want[column], err_msg=column)


def test_scored_stream_is_written_back(spark, scores, tmp_path):
    table = str(tmp_path / "scores")
    scores_io.append_scores(raw_scores(scores, 200), table)
    # The score table is being rewritten, so the stream reads a landed copy of the batch.
    landed = str(tmp_path / "landed")
    scores_io.read_scores(spark, table).drop("observed_date", "batch_id").coalesce(1).write.parquet(landed)
    stream = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
    sink = scoring.stream_score(str(tmp_path / "state"), scoring.write_back(table))
    runs.drain_batches(stream, sink, "t-write-back")
    row = scores_io.read_scores(spark, table).agg(
        F.count(F.lit(1)), F.count("predicted_headway_sec"), F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert row[0] == row[1] == 200 and 0 <= row[2] <= row[3] <= 1


def test_ingest_end_to_end(spark, tmp_path):
    landing, table = str(tmp_path / "landing"), str(tmp_path / "scores")
    vehicle = lambda stop, t: f'{{"vehicle":{{"trip":{{"route_id":"A"}},"stop_id":"{stop}","timestamp":{t}}}}}'
    epoch = int(START.timestamp())
    for i, t in enumerate((10, 70, 60)):
        folder = tmp_path / "landing" / "feed=ACE"
        folder.mkdir(parents=True, exist_ok=True)
        at = (START + timedelta(seconds=30 * i)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
        (folder / f"{i}.json").write_text(f'{{"poll_ts":"{at}","entity":[{vehicle("s", epoch + t)},{vehicle("u", epoch + t)}]}}')
    stream = headways.stream_headway(feeds.feed_flatten(feeds.feed_stream(spark, landing)))
    runs.drain_batches(stream, ingest.scores_sink(table), "t-ingest")
    rows = scores_io.read_scores(spark, table).orderBy("stop_id", "observed_ts").collect()
    assert [r.headway_sec for r in rows] == [None, 60.0, None] * 2
    assert len({r.id for r in rows}) == 6 and {r.window_sec for r in rows} == {300}
    assert all(r.anomaly_score == 0.0 and r.predicted_headway_sec is None for r in rows)


def test_enrich_keeps_unknown_stops(spark, scores, tmp_path):
    path = str(tmp_path / "raw")
    scores([{"stop_id": "s1"}, {"stop_id": "nowhere"}]).write.parquet(path)
    stops = spark.createDataFrame([("s1", "First")], "stop_id string, stop_name string")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    got = {r.stop_id: r.stop_name for r in runs.drain(summaries.stream_enrich(stream, stops), "t-enrich").collect()}
    assert got == {"s1": "First", "nowhere": None}


@pytest.mark.parametrize("slide, step", [("5 minutes", 300), ("15 minutes", 900)])
def test_window_summary_equals_batch_counts(spark, scores, tmp_path, slide, step):
    rows = scores([
        {"observed_ts": START + timedelta(seconds=97 * i), "stop_id": f"s{i % 5}", "anomaly_score": (i % 10) / 10,
         "predicted_headway_sec": None if i % 4 == 0 else 1.0} for i in range(200)
    ])
    path = str(tmp_path / "raw")
    rows.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    got = {r.window_start: r for r in summaries.drain_window_summary(stream, slide=slide, delay="1 minute").collect()}
    want = rows.groupBy(F.window("observed_ts", "15 minutes", slide).alias("w")).agg(
        F.count("predicted_headway_sec").alias("n"),
        F.count_distinct(F.when(F.col("predicted_headway_sec").isNotNull(), F.col("stop_id"))).alias("stops"),
        F.count_if((F.col("anomaly_score") >= 0.6) & F.col("predicted_headway_sec").isNotNull()).alias("anomalies"),
    ).select("w.start", "n", "stops", "anomalies").collect()
    want = {r.start: r for r in want}
    assert set(got) == set(want)
    for start, row in got.items():
        assert (row.scored_rows, row.stations_total, row.anomalies_count) == (
            want[start].n, want[start].stops, want[start].anomalies)
        assert row.anomaly_rate_perc == (round(want[start].anomalies / want[start].n * 100, 2) if want[start].n else 0.0)


def test_windows_close_once_over_many_micro_batches(spark, scores, tmp_path):
    rows = scores([
        {"observed_ts": START + timedelta(seconds=40 * i + (i * 37) % 50), "stop_id": f"s{i % 7}", "route_id": f"R{i % 3}",
         "predicted_headway_sec": 1.0, "anomaly_score": (i % 8) / 8} for i in range(300)
    ])
    path = str(tmp_path / "raw")
    for i in range(5):
        rows.where((F.col("id") >= 60 * i) & (F.col("id") < 60 * i + 60)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    parts, checkpoint = runs.drain_with_checkpoint(
        summaries.stream_window_parts(stream, "9 minutes", "6 minutes", "2 minutes", 3), "t-parts")
    still_open = summaries.open_window_parts(spark, checkpoint, "9 minutes", "6 minutes")
    closed, rest = ({(r.window_start, r.bucket) for r in p.collect()} for p in (parts, still_open))
    assert len(closed) == parts.count() and closed and rest and not closed & rest
    got = {r.window_start: (r.scored_rows, r.stations_total, r.trains_active) for r in summaries.window_totals(parts.union(still_open)).collect()}
    want = rows.groupBy(F.window("observed_ts", "9 minutes", "6 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("stop_id").alias("stops"), F.count_distinct("route_id", "stop_id").alias("pairs"))
    assert got == {r.w.start: (r.n, r.stops, r.pairs) for r in want.collect()}


def test_every_ten_second_window_is_counted(spark, scores, tmp_path):
    rows = scores([
        {"observed_ts": START + timedelta(seconds=23 * i + (i * 29) % 50), "stop_id": f"s{i % 7}", "route_id": f"R{i % 3}",
         "predicted_headway_sec": 1.0, "anomaly_score": (i % 8) / 8} for i in range(180)
    ])
    path = str(tmp_path / "raw")
    for i in range(3):
        rows.where((F.col("id") >= 60 * i) & (F.col("id") < 60 * i + 60)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.window_start: (r.scored_rows, r.anomalies_count, r.stations_total, r.trains_active)
           for r in summaries.drain_window_summary(stream, buckets=3).collect()}
    want = rows.groupBy(F.window("observed_ts", "15 minutes", "10 seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("anomaly_score") >= 0.6).alias("anomalies"),
        F.count_distinct("stop_id").alias("stops"), F.count_distinct("route_id", "stop_id").alias("pairs"))
    assert got == {r.w.start: (r.n, r.anomalies, r.stops, r.pairs) for r in want.collect()}


def one_arrival(spark, path, poll, arrival, stop="s"):
    at = START + timedelta(seconds=30 * poll)
    spark.createDataFrame(
        [(at, "ACE", "A", stop, int(START.timestamp()) + arrival)],
        "poll_ts timestamp, feed string, route_id string, stop_id string, arrival long").coalesce(1).write.mode("append").parquet(path)


def arrivals_stream(spark, path):
    return spark.readStream.schema("poll_ts timestamp, feed string, route_id string, stop_id string, arrival long").option(
        "maxFilesPerTrigger", 1).parquet(path)


def test_a_late_poll_moves_nothing_back(spark, tmp_path):
    path = str(tmp_path / "arrivals")
    for poll, arrival in ((1, 100), (3, 200), (2, 150), (3, 200), (4, 260)):
        one_arrival(spark, path, poll, arrival)
    rows = runs.drain(headways.stream_headway(arrivals_stream(spark, path), buckets=2), "t-late").collect()
    found = sorted((r.poll_ts.minute * 60 + r.poll_ts.second, r.headway_sec) for r in rows if r.headway_sec is not None)
    assert len(rows) == 5 and found == [(90, 100.0), (120, 60.0)]


def test_an_idle_key_is_forgotten(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("arrivals", "out", "offsets"))
    one_arrival(spark, path, 1, 100)
    one_arrival(spark, path, 1, 100, "other")
    run = lambda: runs.start(headways.stream_headway(arrivals_stream(spark, path), 2, idle_ms=1500), out, checkpoint).awaitTermination()
    run()
    time.sleep(2)
    one_arrival(spark, path, 2, 170)
    run()
    assert [r.prev_arrival for r in spark.read.parquet(out).collect()] == [None] * 3
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last_arrivals").load()
    assert [r.stop_id for r in state.select("user_map_key.stop_id").collect()] == ["s"]


def test_window_state_is_cut_by_time(spark, scores, tmp_path):
    # One micro-batch of four days: no key of the state may hold them all.
    rows = scores([
        {"stop_id": f"s{i % 3}", "observed_ts": START + timedelta(minutes=10 * i), "predicted_headway_sec": 90.0} for i in range(576)])
    rows.coalesce(1).write.parquet(str(tmp_path / "days"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "days"))
    _, checkpoint = runs.drain_with_checkpoint(
        summaries.stream_window_parts(stream, "15 minutes", "5 minutes", buckets=2), "t-spans")
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "panes").load()
    held = [r.n for r in state.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(held) > 20 and max(held) <= (16 * 15 + 15) // 5
