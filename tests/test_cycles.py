from datetime import timedelta

import numpy as np
import pytest

from headwise.operators import online
from headwise.plans.cycles import score_cycle, shadow_cycle
from headwise.sources import model_state, scores as scores_io, telemetry
from tests.conftest import START


@pytest.fixture
def paths(tmp_path):
    return [str(tmp_path / name) for name in ("scores", "state", "telemetry")]


def test_first_cycle_scores_a_few_rows(spark, scores, paths):
    """Five raw rows of one key get finite predictions, residuals and scores."""
    ages, headways = (240, 180, 120, 60, 30), (300.0, 90.0, 420.0, 240.0, 600.0)
    rows = scores([{"observed_ts": START - timedelta(seconds=a), "headway_sec": h} for a, h in zip(ages, headways)])
    scores_io.append_scores(rows, paths[0])
    score_cycle(spark, *paths, now=START)
    for row in scores_io.read_scores(spark, paths[0]).collect():
        assert np.isfinite([row.predicted_headway_sec, row.residual, row.anomaly_score]).all()
        assert 0 <= row.anomaly_score <= 1 and row.window_sec == 300
    got = telemetry.telemetry_read(spark, paths[2]).first()
    assert (got.status, got.rows_seen, got.unscored_backlog, got.last_batch_processed) == ("available", 5, 0, 5)


def test_cycles_continue_each_other(spark, scores, paths):
    rng = np.random.default_rng(3)
    rows = scores([
        {"route_id": "AB"[i % 2], "stop_id": f"s{i % 5}", "headway_sec": float(rng.gamma(2, 150)) if i % 50 else -1.0}
        for i in range(300)
    ]).cache()
    scores_io.append_scores(rows, paths[0])
    want = online.score_online(rows).toPandas().sort_values("id", ignore_index=True)
    for i in range(3):
        score_cycle(spark, *paths, now=START + timedelta(minutes=i), batch_limit=64, max_batches=2)
    got = scores_io.read_scores(spark, paths[0]).where("predicted_headway_sec is not null").toPandas()
    got = got.sort_values("id", ignore_index=True)
    assert got["id"].tolist() == want["id"].tolist() and len(got) == 294
    np.testing.assert_allclose(got["predicted_headway_sec"], want["predicted_headway_sec"])
    np.testing.assert_allclose(got["anomaly_score"], want["anomaly_score"])
    told = telemetry.telemetry_read(spark, paths[2]).first()
    assert (told.rows_seen, told.rows_updated, told.unscored_backlog, told.last_batch_processed) == (294, 294, 6, 38)
    # A cycle without usable rows keeps the figures and the state.
    score_cycle(spark, *paths, now=START + timedelta(minutes=9), batch_limit=64, max_batches=2)
    idle = telemetry.telemetry_read(spark, paths[2]).first()
    assert (idle.rows_seen, idle.rows_updated, idle.mae_ema, idle.last_batch_processed) == (294, 294, told.mae_ema, 38)
    assert sorted(r.rows_seen for r in model_state.load_state(spark, paths[1]).collect()) == [144, 150]


def test_shadow_cycle(spark, scores, paths):
    rng = np.random.default_rng(5)
    rows = scores([
        {"headway_sec": float(h), "predicted_headway_sec": 300.0, "residual": float(h) - 300, "anomaly_score": 0.1 * (i % 9)}
        for i, h in enumerate(rng.gamma(2, 150, 600))
    ])
    scores_io.append_scores(rows, paths[0])
    now = START + timedelta(minutes=30)
    first = shadow_cycle(spark, *paths, now=now).first()
    second = shadow_cycle(spark, *paths, now=now + timedelta(minutes=2), limit=400).first()
    assert (first.status, first.samples_used, second.samples_used) == ("available", 600, 400)
    assert len(model_state.load_weights(spark, paths[1])) == 2510
    assert telemetry.shadow_health_read(spark, paths[2]).first().samples_used == 400
    late = shadow_cycle(spark, *paths, now=now + timedelta(days=1)).first()
    assert (late.status, late.note) == ("unavailable", "insufficient_scored_rows")
