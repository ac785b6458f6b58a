import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headwise.operators import autoencoder, online
from headwise.operators.learner import (
    TREE_BLOCK, TREE_HEIGHT, TREES, AdaptiveWindow, HalfSpaceTrees, PassiveAggressive, RouteSequence,
)


def headways(n, seed=0, shift=None):
    rng = np.random.default_rng(seed)
    y = rng.gamma(2.0, 150.0, n)
    if shift:
        y[shift:] += 4000.0
    x = np.column_stack([rng.integers(0, 24, n), np.full(n, 0.3), rng.random(n)])
    return x.astype(float), y


def test_regression_against_whole_history_statistics():
    """Every step recomputed from scratch with numpy's mean and deviation."""
    x, y = headways(300)
    model, weight, bias = PassiveAggressive(), np.zeros(3), 0.0
    for i in range(len(y)):
        before = x[:i]
        if i:
            std = before.std(axis=0)
            z = np.where(std > 1e-12, (x[i] - before.mean(axis=0)) / np.where(std > 1e-12, std, 1), 0)
        else:
            z = np.zeros(3)
        assert model.predict(x[i].tolist()) == pytest.approx(weight @ z + bias, abs=1e-6)
        model.learn(x[i].tolist(), y[i])
        after = x[:i + 1]
        std = after.std(axis=0)
        z = np.where(std > 1e-12, (x[i] - after.mean(axis=0)) / np.where(std > 1e-12, std, 1), 0)
        error = y[i] - (weight @ z + bias)
        loss = max(0.0, abs(error) - 0.1)
        step = np.sign(error) * (min(1.0, loss / (z @ z)) if z @ z > 0 else min(1.0, loss))
        weight, bias = weight + step * z, bias + step


def test_adaptive_window_sees_a_shift_only_when_there_is_one():
    rng = np.random.default_rng(1)
    steady, window = rng.random(5000) * 0.2, AdaptiveWindow()
    assert not any(window.add(v) for v in steady)
    assert sum(b[0] for b in window.buckets) == 5000
    assert sum(b[1] for b in window.buckets) == pytest.approx(steady.sum())
    hits = [i for i in range(2000) if window.add(0.6 + 0.2 * rng.random())]
    assert hits and hits[0] < 200
    assert len(window.buckets) < 90


def naive_trees(residual, hour):
    """Row by row and node by node."""
    table = HalfSpaceTrees
    latest, reference = np.zeros((TREES, 511)), np.zeros((TREES, 511))
    first, filled, scores = True, 0, []
    for r, h in zip(residual, hour):
        point = (min(max(r / 7200 + 0.5, 0), 1), h / 24)
        total = 0.0
        for t in range(TREES):
            node, open_walk = 0, True
            for depth in range(TREE_HEIGHT + 1):
                if open_walk:
                    total += reference[t, node] * 2 ** depth
                    open_walk = reference[t, node] >= 0.1 * TREE_BLOCK
                latest[t, node] += 1
                if depth < TREE_HEIGHT:
                    right = point[table.attribute[t, node]] >= table.threshold[t, node]
                    node = 2 * node + 1 + int(right)
        scores.append(0.0 if first else 1 - total / (TREES * TREE_BLOCK * 511))
        filled += 1
        if filled == TREE_BLOCK:
            reference, latest, first, filled = latest, np.zeros((TREES, 511)), False, 0
    return scores


def test_trees_match_row_by_row_walk():
    rng = np.random.default_rng(2)
    residual, hour = rng.normal(0, 600, 900), rng.integers(0, 24, 900).astype(float)
    scores = HalfSpaceTrees().advance(residual, hour)
    np.testing.assert_allclose(scores, naive_trees(residual, hour), atol=1e-12)
    assert (scores[:TREE_BLOCK] == 0).all() and scores[TREE_BLOCK:].min() > 0
    parts, trees = [], HalfSpaceTrees()
    for piece in np.split(np.arange(900), [1, 100, 251, 640]):
        parts.append(trees.advance(residual[piece], hour[piece]))
    np.testing.assert_array_equal(np.concatenate(parts), scores)


def row_by_row(x, y):
    """The whole learner in one loop: what the composed operators must equal."""
    regression, window, trees = PassiveAggressive(), AdaptiveWindow(), HalfSpaceTrees()
    history, ema, rows = [], 0.0, []
    for i, (features, target) in enumerate(zip(x.tolist(), y.tolist())):
        if i % 1024 == 0:
            history = history[-8000:]
        guess = regression.predict(features) or target
        miss = target - guess
        size = abs(miss)
        ema = size if i == 0 else 0.92 * ema + 0.08 * size
        q50, q90, q99 = np.percentile(history, [50, 90, 99]) if history else (np.nan,) * 3
        tree = trees.advance(np.array([miss]), np.array(features[:1]))[0]
        drifted = window.add(min(size / 3600, 1.0))
        if drifted:
            regression, trees = PassiveAggressive(), HalfSpaceTrees()
        regression.learn(features, target)
        rows.append((guess, miss, ema, len(history), q50, q90, q99, tree, drifted))
        history.append(size)
    names = ["predicted_headway_sec", "residual", "ema", "history_n", "q50", "q90", "q99", "tree_score", "drifted"]
    return dict(zip(names, map(np.array, zip(*rows))))


def score_rows(scores, n, routes=("A", "B"), shift=None):
    rng = np.random.default_rng(9)
    return scores([
        {"route_id": routes[int(rng.integers(len(routes)))], "stop_id": f"s{i % 7}",
         "headway_sec": float(rng.gamma(2, 150)) + (4000.0 if shift and i % (2 * shift) >= shift else 0.0)}
        for i in range(n)
    ])


def by_route(scored):
    frame = scored.toPandas().sort_values(["route_id", "seq"], ignore_index=True)
    return dict(tuple(frame.groupby("route_id")))


def test_scores_equal_the_row_by_row_learner_with_drifts(spark, scores):
    rows = score_rows(scores, 5000, shift=1500).cache()
    got = by_route(online.score_online(rows))
    features = online.online_features(rows).toPandas()
    drifts = 0
    for route, part in features.groupby("route_id"):
        part = part.sort_values("observed_ts")
        want = row_by_row(part[online.FEATURES].to_numpy(), part["headway_sec"].to_numpy())
        drifts += int(want["drifted"].sum())
        for name, column in want.items():
            np.testing.assert_allclose(got[route][name].astype(float), column.astype(float), rtol=1e-9, atol=1e-9, err_msg=name)
        assert got[route]["anomaly_score"].between(0, 1).all()
    assert drifts >= 2


@pytest.mark.parametrize("tree_chunk", [250, 500, 2000])
def test_scores_do_not_depend_on_chunk_sizes(spark, scores, tree_chunk):
    rows = score_rows(scores, 12_000, routes=("A",), shift=5000).cache()
    whole = by_route(online.score_online(rows))["A"]
    cut = by_route(online.score_online(rows, tree_chunk=tree_chunk, history_chunk=9 * 1024))["A"]
    for name in ("predicted_headway_sec", "ema", "q50", "q90", "q99", "tree_score", "anomaly_score"):
        np.testing.assert_allclose(cut[name], whole[name], rtol=1e-9, atol=1e-9, err_msg=name)
    assert cut["drifted"].tolist() == whole["drifted"].tolist() and whole["drifted"].any()


def test_later_rows_continue_from_states_and_tail(spark, scores):
    rows = score_rows(scores, 14_000, routes=("A",), shift=6000).cache()
    whole = by_route(online.score_online(rows))["A"]
    states = tail = None
    parts = []
    for low, high in ((0, 30), (30, 1100), (1100, 11_500), (11_500, 14_000)):
        part = rows.where((F.col("id") >= low) & (F.col("id") < high))
        scored, passed = online.score_rows(part, states, tail)
        parts.append(scored.toPandas())
        states = online.route_states(passed, scored, states).cache()
        tail = online.tail_rows(passed, tail).cache()
        assert tail.count() <= 8192 + 2 * 1024
    got = pd.concat(parts).sort_values("seq", ignore_index=True)
    for name in ("predicted_headway_sec", "ema", "history_n", "q50", "q90", "q99", "tree_score", "anomaly_score"):
        np.testing.assert_allclose(got[name].astype(float), whole[name].astype(float), rtol=1e-9, atol=1e-9, err_msg=name)
    state = states.first()
    assert (state.rows_seen, state.drift_events) == (14_000, int(whole["drifted"].sum()))
    assert state.mae_ema == pytest.approx(whole["ema"].iloc[-1])


def test_states_equal_the_row_by_row_state(spark, scores):
    rows = score_rows(scores, 3000, shift=1000).cache()
    states, tail = online.learner_states(rows)
    features = online.online_features(rows).toPandas()
    tails = {r: t.sort_values("seq") for r, t in tail.toPandas().groupby("route_id")}
    for state in states.collect():
        part = features[features.route_id == state.route_id].sort_values("observed_ts")
        x, y = part[online.FEATURES].to_numpy(), part["headway_sec"].to_numpy()
        want, route = row_by_row(x, y), RouteSequence()
        route.advance(x, y)
        assert state.rows_seen == len(y) and state.drift_events == want["drifted"].sum()
        assert state.mae_ema == pytest.approx(want["ema"][-1])
        assert RouteSequence.from_json(state.state).to_json() == route.to_json()
        np.testing.assert_allclose(tails[state.route_id]["residual"], want["residual"][-len(tails[state.route_id]):])


def test_drift_epochs_count_over_the_whole_route(spark, scores):
    rows = score_rows(scores, 6000, routes=("A", "B", "C"), shift=1500).withColumn("residual", F.col("headway_sec") - 300)
    got = by_route(online.drift_adwin(rows))
    for route, part in rows.toPandas().groupby("route_id"):
        window, drifted = AdaptiveWindow(), []
        for value in part.sort_values("observed_ts")["residual"]:
            drifted.append(window.add(min(abs(value) / 3600, 1.0)))
        assert got[route]["drifted"].tolist() == drifted and sum(drifted) >= 2
        assert got[route]["epoch"].tolist() == (np.cumsum(drifted) - drifted).tolist()


def test_few_rows_report_no_quantiles(spark, scores):
    scored = online.score_online(score_rows(scores, 90)).cache()
    row = online.telemetry_online(scored, spark.range(1), F.lit("now")).first()
    assert (row.rows_seen, row.residual_q90, row.residual_q99, row.last_batch_processed) == (90, 0.0, 0.0, 90)
    assert online.telemetry_online(scored.limit(0), spark.range(1), F.lit("now")).first().last_batch_processed == 0


def test_autoencoder_gradient_and_learning():
    rng = np.random.default_rng(0)
    flat, x = autoencoder.initial_weights(), rng.normal(size=(16, 10))
    assert len(flat) == 2510
    _, grad = autoencoder.gradient(flat, x, x)
    for i in rng.integers(0, len(flat), 40):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (autoencoder.gradient(flat + s, x, x)[0] for s in (step, -step))
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    data = rng.normal(size=(4096, 2)) @ rng.normal(size=(2, 10))
    data = (data - data.mean(0)) / data.std(0)
    learner = autoencoder.Adam(flat)
    before, keys = autoencoder.row_errors(flat, data).mean(), np.arange(len(data))
    for step in range(240):
        part = slice(step % 4 * 1024, step % 4 * 1024 + 1024)
        loss, grad = autoencoder.gradient(learner.flat, autoencoder.corrupt(data[part], keys[part], step // 4), data[part])
        learner.step(grad)
    assert autoencoder.row_errors(learner.flat, data).mean() < 0.3 * before and math.isfinite(loss)


def test_corruption_depends_on_keys_only():
    rng = np.random.default_rng(3)
    x, keys = np.ones((20_000, 10)), rng.integers(-2**63, 2**63 - 1, 20_000)
    whole = autoencoder.corrupt(x, keys, 5)
    order = rng.permutation(len(x))
    np.testing.assert_array_equal(autoencoder.corrupt(x[order], keys[order], 5), whole[order])
    kept = whole[whole != 0]
    assert (whole == 0).mean() == pytest.approx(0.2, abs=0.005)
    assert kept.mean() == pytest.approx(1, abs=0.002) and kept.std() == pytest.approx(0.08, abs=0.002)
    # Other seeds and neighbouring places draw other numbers.
    other = autoencoder.corrupt(x, keys, 6)
    assert abs(np.corrcoef(whole.ravel(), other.ravel())[0, 1]) < 0.01
    assert abs(np.corrcoef(whole[:, 0], whole[:, 1])[0, 1]) < 0.03


def test_inlined_sequence_equals_the_step_classes():
    x, y = headways(4000, seed=3, shift=2500)
    y[1200:1800] += 3000.0
    model, window, want = PassiveAggressive(), AdaptiveWindow(), []
    for features, target in zip(x.tolist(), y.tolist()):
        guess = model.predict(features) or target
        drifted = window.add(min(abs(target - guess) / 3600.0, 1.0))
        want.append((guess, drifted))
        if drifted:
            model = PassiveAggressive()
        model.learn(features, target)
    route, got = RouteSequence(), []
    for part in np.array_split(np.arange(len(y)), 5):
        out = route.advance(x[part], y[part])
        got += list(zip(out["predicted_headway_sec"], out["drifted"].tolist()))
        route = RouteSequence.from_json(route.to_json())
    assert got == want and sum(d for _, d in want) >= 2
    assert (route.regression.weight, route.regression.bias, route.regression.n) == (model.weight, model.bias, model.n)
