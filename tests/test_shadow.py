import numpy as np
from pyspark.sql import functions as F

from headwise.operators import autoencoder, shadow
from headwise.operators.filters import scored


def rows_for(scores, n):
    rng = np.random.default_rng(6)
    return scores([
        {"route_id": "AB"[i % 2], "stop_id": f"s{i % 11}", "headway_sec": float(h), "predicted_headway_sec": 300.0,
         "residual": float(h) - 300.0, "anomaly_score": min(1.0, abs(float(h) - 300.0) / 1000)}
        for i, h in enumerate(rng.gamma(2, 150, n))
    ])


def test_too_few_rows(scores):
    row = shadow.telemetry_shadow(scored(rows_for(scores, 255)), F.lit("t")).first()
    assert (row.status, row.note, row.samples_used) == ("unavailable", "insufficient_scored_rows", 255)
    assert row.top_shadow_events == []


def test_standardised_with_population_deviation(scores):
    matrix = shadow.standardise_matrix(shadow.shadow_features(rows_for(scores, 400))).toPandas()
    values = matrix[shadow.FEATURES].to_numpy()
    np.testing.assert_allclose(values.mean(axis=0), 0, atol=1e-9)
    # A constant feature is centred and left unscaled.
    assert (matrix["predicted_headway_sec"] == 0).all()
    np.testing.assert_allclose(matrix["headway_sec"].std(ddof=0), 1)


def test_training_telemetry_and_warm_start(scores):
    rows = rows_for(scores, 1200).cache()
    row, weights = shadow.run_shadow(rows, F.lit("t"))
    out = row.first()
    assert out.status == "available" and out.samples_used == 1200 and out.train_epochs == 4
    assert 0 <= out.recon_error_p90 <= out.recon_error_p99 <= out.recon_error_max
    assert out.shadow_alerts_high == 12 and -1 <= out.corr_with_online_score <= 1
    events = out.top_shadow_events
    assert len(events) == 5 and [e.dl_error for e in events] == sorted((e.dl_error for e in events), reverse=True)
    assert events[0].stop_name == events[0].stop_id
    _, _, cold = shadow.shadow_autoencoder(shadow.standardise_matrix(shadow.shadow_features(rows)), None, 1)
    _, _, warm = shadow.shadow_autoencoder(shadow.standardise_matrix(shadow.shadow_features(rows)), weights, 1)
    assert warm < cold


def test_training_does_not_depend_on_partitions(scores):
    features = shadow.shadow_features(rows_for(scores, 900))
    runs = [shadow.shadow_autoencoder(shadow.standardise_matrix(features.repartition(n)), None, 2) for n in (1, 8, 64)]
    errors = [{r.id: r.err for r in run[0].collect()} for run in runs]
    for weights, found in zip((run[1] for run in runs[1:]), errors[1:]):
        np.testing.assert_allclose(runs[0][1], weights, rtol=1e-6, atol=1e-9)
        assert found.keys() == errors[0].keys() and all(abs(errors[0][i] - found[i]) < 1e-6 for i in found)


def test_training_equals_steps_on_one_machine(scores):
    matrix = shadow.standardise_matrix(shadow.shadow_features(rows_for(scores, 700)))
    _, weights, loss = shadow.shadow_autoencoder(matrix, None, 2, seed=4, steps=3)
    held = matrix.withColumn("key", F.xxhash64("id")).toPandas()
    x, keys = held[shadow.FEATURES].to_numpy(), held["key"].to_numpy()
    learner = autoencoder.Adam(autoencoder.initial_weights(4))
    for epoch in range(2):
        losses = []
        for step in range(3):
            mine = keys % 3 == step
            one, grad = autoencoder.gradient(learner.flat, autoencoder.corrupt(x[mine], keys[mine], 4 + epoch), x[mine])
            learner.step(grad)
            losses.append(one * mine.sum())
    np.testing.assert_allclose(weights, learner.flat, rtol=1e-6, atol=1e-9)
    assert abs(loss - sum(losses) / len(x)) < 1e-9


def test_steps_without_rows_are_left_out(scores):
    matrix = shadow.standardise_matrix(shadow.shadow_features(rows_for(scores, 2)))
    rows, weights, loss = shadow.shadow_autoencoder(matrix, None, 1, steps=5)
    assert rows.count() == 2 and np.isfinite(weights).all() and np.isfinite(loss)
    empty, weights, loss = shadow.shadow_autoencoder(matrix.limit(0), None, 1, steps=2)
    assert empty.count() == 0 and loss == 0.0
    np.testing.assert_array_equal(weights, autoencoder.initial_weights(7))
