from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from headwise.operators import aggregates, drift, filters, quantiles, ranking, windows
from headwise.operators.sequence import number_rows, replay_chunks
from tests.conftest import START


def test_horizon_is_inclusive(spark):
    now = 1_700_000_000
    rows = spark.createDataFrame([(now + d,) for d in (-3601, -3600, 14400, 14401)], "arrival long")
    kept = sorted(r.arrival - now for r in filters.arrival_horizon_filter(rows, now).collect())
    assert kept == [-3600, 14400]


def test_earliest_and_headways(spark):
    polls = [(0, 120), (0, 100), (1, 400), (2, 400), (3, 350), (30, 500)]
    rows = spark.createDataFrame(
        [(START + timedelta(hours=h), "ACE", "A", "s", a) for h, a in polls],
        "poll_ts timestamp, feed string, route_id string, stop_id string, arrival long",
    )
    got = [r.headway_sec for r in windows.headway_lag(aggregates.earliest_arrival(rows)).orderBy("poll_ts").collect()]
    # The last poll lies in another day slice and still sees the previous arrival.
    assert got == [None, 300.0, None, None, 150.0]


def test_feeds_of_one_poll_share_the_last_arrival(spark):
    rows = spark.createDataFrame(
        [(START, "L", "A", "s", 500), (START, "ACE", "A", "s", 200)],
        "poll_ts timestamp, feed string, route_id string, stop_id string, arrival long",
    )
    got = {r.feed: r.headway_sec for r in windows.headway_lag(rows).collect()}
    assert got == {"ACE": None, "L": 300.0}


def test_median_mad(spark, scores):
    rows = scores([{"headway_sec": h} for h in (60.0, 120.0, 600.0, 0.0, -5.0, None)])
    row = aggregates.headway_median_mad(rows).first()
    assert (row["median"], row["mad"], row["hour"]) == (120.0, 60.0, 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_histogram_quantiles_are_exact(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([
        rng.normal(0, 50, 4000), np.full(3000, 7.25), np.zeros(200), rng.exponential(1e-5, 500), -rng.exponential(1e6, 300),
    ])
    hot = rng.random(len(values)) < 0.9
    rows = spark.createDataFrame([("hot" if h else "cold", float(v)) for h, v in zip(hot, values)], "k string, x double")
    probs = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    got = {r.k: r for r in quantiles.exact_quantiles(rows, ["k"], "x", probs).collect()}
    for name, part in (("hot", values[hot]), ("cold", values[~hot])):
        assert got[name].n == len(part)
        np.testing.assert_allclose(got[name].quantiles, np.quantile(part, probs), rtol=1e-12, atol=1e-12)
    whole = quantiles.exact_quantiles(rows, [], "x", [0.5, 0.99]).first()
    np.testing.assert_allclose(whole.quantiles, np.quantile(values, [0.5, 0.99]), rtol=1e-12)


def test_error_quantiles(spark):
    err = np.random.default_rng(0).exponential(1.0, 3000)
    rows = spark.createDataFrame([(float(e),) for e in err], "err double")
    small = aggregates.error_quantiles(rows).first()
    assert list(small)[:3] == pytest.approx([*np.percentile(err, [90, 99]), err.max()])
    assert small.shadow_alerts_high == int((err >= np.percentile(err, 99)).sum())


def test_correlation_guard(spark):
    rows = spark.createDataFrame([(1.0, 0.5), (1.0, 0.7)], "err double, online_score double")
    assert aggregates.score_correlation(rows).first()[0] == 0.0


def test_numbering_with_a_hot_key_and_equal_times(spark):
    rows = spark.range(5000).select(
        "id", F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("k"),
        (F.col("id") % 3).alias("t"),
    )
    got = number_rows(rows, ["k"], ["t", "id"], ["t"]).toPandas()
    for key, part in got.groupby("k"):
        part = part.sort_values(["t", "id"])
        assert part["seq"].tolist() == list(range(len(part)))


def test_replay_chunks_cover_each_row_once(spark):
    rows = number_rows(spark.range(100).select("id", F.lit("a").alias("k"), (F.col("id") / 7).cast("int").alias("s")), ["k"], ["id"], ["s"])
    got = replay_chunks(rows, "seq", 32, 8).toPandas()
    assert sorted(got[got.live].seq) == list(range(100))
    assert sorted(got[~got.live].seq) == [*range(24, 32), *range(56, 64), *range(88, 96)]
    assert got["chunk"].max() == 3
    assert got.groupby("chunk").size().max() <= 40


def test_ema_matches_recurrence(spark):
    rng = np.random.default_rng(3)
    x = rng.exponential(300, 5000)
    rows = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(x)], "id long, route_id string, x double")
    got = windows.ema_scale(number_rows(rows, ["route_id"], ["id"], []), "x").orderBy("id").toPandas()["ema"]
    want = [x[0]]
    for v in x[1:]:
        want.append(0.92 * want[-1] + 0.08 * v)
    np.testing.assert_allclose(got, want, rtol=1e-10)
    short = spark.createDataFrame([(0, "a", 10.0), (1, "a", 20.0), (2, "a", 30.0)], rows.schema)
    emas = windows.ema_scale(number_rows(short, ["route_id"], ["id"], []), "x").orderBy("id").toPandas()["ema"]
    np.testing.assert_allclose(emas, [10, 10.8, 12.336])


def test_rolling_quantiles_across_chunks(spark):
    x = np.random.default_rng(4).exponential(100, 12_000)
    rows = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(x)], "id long, route_id string, x double")
    numbered = number_rows(rows, ["route_id"], ["id"], [])
    chunked = windows.residual_quantiles(numbered, "x", chunk_rows=9 * 1024).orderBy("seq").toPandas()
    for i in (0, 1, 63, 64, 1500, 8191, 8192, 9216, 9217, 10_240, 11_999):
        start = max(0, i // 1024 * 1024 - 8000)
        row = chunked.iloc[i]
        assert row.history_n == i - start
        if i:
            np.testing.assert_allclose([row.q50, row.q90, row.q99], np.percentile(x[start:i], [50, 90, 99]))


def test_first_page_and_page_past_the_end(scores):
    rows = scores([{"anomaly_score": i / 100, "predicted_headway_sec": 1.0} for i in range(45)])
    ranked = ranking.top_anomalies(rows, 45)
    assert [r.id for r in ranking.anomaly_page(ranked, 1).collect()] == list(range(44, 24, -1))
    assert [r.id for r in ranking.anomaly_page(ranked, 99).collect()] == [4, 3, 2, 1, 0]
    with pytest.raises(ValueError):
        ranking.top_anomalies(rows, 10)


def test_fifo_skips_useless_headways(scores):
    rows = scores([{"headway_sec": h} for h in (0.0, -1.0, None, 5.0, 6.0)] + [{"predicted_headway_sec": 1.0}])
    assert [r.id for r in ranking.fifo_unscored_batch(rows, 64).collect()] == [3, 4]


def test_distinct_routes_fallback(spark, scores):
    static = spark.createDataFrame([("X",), (" ",)], "route_id string")
    seen = scores([{"route_id": r} for r in ("B", "A", " ", "A")])
    late = F.lit("2024-02-01").cast("timestamp")
    assert sorted(r[0] for r in aggregates.distinct_routes(seen, static).collect()) == ["A", "B"]
    assert [r[0] for r in aggregates.distinct_routes(seen, static, late).collect()] == ["X"]


def test_top1_prefers_newest_then_highest_id(scores):
    rows = scores([
        {"stop_id": "s", "anomaly_score": 0.9}, {"stop_id": "s", "anomaly_score": 0.9},
        {"stop_id": "s", "anomaly_score": 0.2}, {"stop_id": "t", "anomaly_score": 0.1},
    ])
    assert sorted((r.stop_id, r.id) for r in windows.top1_per_stop(rows).collect()) == [("s", 1), ("t", 3)]


def test_cut_scan_finds_a_level_shift(spark):
    rows = spark.createDataFrame(
        [("A", START + timedelta(hours=h), 100.0 if h < 480 else 1500.0) for h in range(960)],
        "route_id string, observed_ts timestamp, residual double",
    )
    cuts = {r.bucket: r.is_cut for r in drift.drift_cut_scan(rows).collect()}
    assert len(cuts) == 39 and sum(cuts.values()) > 0
    best = drift.drift_cut_scan(rows).orderBy(F.desc(F.abs(F.col("mean0") - F.col("mean1")) - F.col("epsilon"))).first()
    assert best.n0 == 480


def test_text_headways(spark):
    rows = spark.createDataFrame([Row(headway_sec=t) for t in ("12.5", "n/a", "-3", "0", None, "NaN")])
    assert [r.headway_sec for r in filters.positive_headway(rows).collect()] == [12.5]


def test_quantiles_leave_out_nulls_and_nans(spark):
    rows = spark.createDataFrame(
        [("a", float(v)) for v in (1, 2, 3, 4)] + [("a", float("nan")), ("a", None), ("b", float("nan"))], "k string, x double")
    found = quantiles.exact_quantiles(rows, ["k"], "x", [0.5, 1.0]).collect()
    assert [(r.k, r.n, list(r.quantiles)) for r in found] == [("a", 4, [2.5, 4.0])]
    middle = quantiles.exact_median_mad(rows, ["k"], "x").collect()
    assert [(r.k, r["median"], r["mad"]) for r in middle] == [("a", 2.5, 1.0)]


def test_quantiles_of_infinities_and_null_groups(spark):
    inf = float("inf")
    groups = {"up": [1.0, 2.0, inf], "down": [-inf, -inf, 5.0, 7.0], "both": [-inf, inf], "all": [inf, inf], None: [3.0, 4.0, 4.0, 9.0],
              "tiny": [5e-324, -5e-324, 0.0, 1.7e308, -1.7e308]}
    rows = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values], "k string, x double")
    found = {r.k: (r.n, list(r.quantiles)) for r in quantiles.exact_quantiles(rows, ["k"], "x", [0.0, 0.5, 1.0]).collect()}
    assert found["up"] == (3, [1.0, 2.0, inf]) and found["all"] == (2, [inf] * 3) and found[None] == (4, [3.0, 4.0, 9.0])
    assert found["down"] == (4, [-inf, -inf, 7.0])
    assert found["both"][1][0] == -inf and np.isnan(found["both"][1][1]) and found["both"][1][2] == inf
    assert found["tiny"] == (5, [-1.7e308, 0.0, 1.7e308])
    middle = {r.k: (r["median"], r["mad"]) for r in quantiles.exact_median_mad(rows, ["k"], "x").collect()}
    assert middle["up"] == (2.0, 1.0) and middle[None] == (4.0, 0.5) and middle["all"] == (inf, None)
    assert quantiles.exact_quantiles(rows.limit(0), ["k"], "x", [0.5]).count() == 0
    assert quantiles.exact_quantiles(rows.limit(0), [], "x", [0.5]).count() == 0
