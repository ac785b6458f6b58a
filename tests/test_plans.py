"""Physical plans: what must hold whatever the data size."""
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from headwise.operators import aggregates, filters, ranking, windows
from headwise.plans import serve
from headwise.sources import scores as scores_io
from tests.conftest import START


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, scores, tmp_path):
    path = str(tmp_path / "scores")
    scores_io.append_scores(scores([
        {"observed_ts": START + timedelta(days=i), "predicted_headway_sec": 1.0, "route_id": "AB"[i % 2]} for i in range(10)
    ]), path)
    return scores_io.read_scores(spark, path)


def test_window_prunes_partitions_and_reaches_the_scan(stored):
    rows = filters.route_filter(filters.recent_window_filter(stored, "24h", START + timedelta(days=9)), "B")
    text = plan(rows.select("id"))
    assert "PartitionFilters: [isnotnull(observed_date" in text and ">= 2024-01-09" in text
    assert "GreaterThanOrEqual(observed_ts" in text and "EqualTo(route_id,B)" in text
    assert "headway_sec" not in text.split("ReadSchema")[1]
    assert rows.count() == 1


def test_default_as_of_also_prunes(stored):
    rows = filters.recent_window_filter(stored, "24h")
    assert rows.count() == 2
    assert "PartitionFilters: [isnotnull(observed_date" in plan(rows.select("id"))


def test_top_k_needs_no_full_sort(stored):
    assert "TakeOrderedAndProject" in plan(ranking.top_anomalies(stored, 20))


def test_top1_limits_groups_before_the_shuffle(stored):
    text = plan(windows.top1_per_stop(stored))
    assert text.count("WindowGroupLimit") == 2


def test_summary_counts_in_one_scan_without_expand(stored):
    text = plan(aggregates.window_counts(stored))
    assert text.count("FileScan") == 1 and "Expand" not in text and "partial_" in text


def test_scans_read_only_needed_columns(stored):
    text = plan(serve.summary(stored, "24h", START + timedelta(days=9)))
    assert "window_sec" not in text and "event_ts" not in text


def test_no_cross_products(spark, stored):
    stops = spark.createDataFrame([("s1", "One", 1.0, 2.0)], "stop_id string, stop_name string, lat double, lon double")
    for df in (
        serve.summary(stored), serve.freshness(stored, stops), serve.heatmap(stored, stops),
        aggregates.error_quantiles(stored.withColumn("err", F.col("anomaly_score"))),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
