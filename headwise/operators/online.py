"""Online scoring, composed of operators.

Only the regression weights and the drift window of a route are sequential by nature. They run alone, in strict
order, over the rows of a route (:func:`in_order`). Everything else is windowed over the columns that this pass
gives: the error scale, the residual quantiles, and the half-space trees of each epoch between two drifts. So a
score does not depend on how large a table is or how it is cut. A later batch continues from the saved states
and from the last rows of each route (:func:`tail_rows`).
"""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from headwise.functions.clock import hour_utc
from headwise.functions.hashing import stable_hash_unit
from headwise.functions.scoring import composite_score, relative_error, ssl_residual_score
from headwise.operators.filters import positive_headway, unscored
from headwise.operators.learner import RESIDUAL_SPAN, TREE_BLOCK, AdaptiveWindow, HalfSpaceTrees, PassiveAggressive, RouteSequence
from headwise.operators.sequence import in_order, number_rows, replay_chunks
from headwise.operators.windows import ema_scale, residual_quantiles
from headwise.schema import RESIDUAL_HISTORY, RESIDUAL_HISTORY_MIN, ROUTE_HASH_MOD, SCORING_BATCH, STOP_HASH_MOD, plain_fields
from headwise.session import write_and_read

# Rows that one task of the trees takes; a multiple of their block.
TREE_CHUNK_ROWS = 200 * TREE_BLOCK

FEATURES = ["hour", "route_hash", "stop_hash"]
_SEQUENCE = "seq long, epoch long, epoch_seq long, predicted_headway_sec double, residual double, drifted boolean"
SEQUENCE = T.StructType(plain_fields(f"route_id string, id long, observed_ts timestamp, hour double, {_SEQUENCE}"))


def online_features(rows):
    """Numeric features of a headway row: UTC hour and two hashed identifiers."""
    return rows.withColumns({
        "hour": hour_utc(F.col("observed_ts")).cast("double"),
        "route_hash": stable_hash_unit(F.col("route_id"), ROUTE_HASH_MOD),
        "stop_hash": stable_hash_unit(F.col("stop_id"), STOP_HASH_MOD),
    })


def number_by_route(rows, *columns):
    """Rows numbered by time within their route; the hours of a route are numbered apart."""
    hourly = rows.select("id", "route_id", "observed_ts", *columns, F.date_trunc("hour", "observed_ts").alias("_hour"))
    return number_rows(hourly, ["route_id"], ["observed_ts", "id"], ["_hour"]).drop("_hour")


class _Scoring(RouteSequence):
    """The sequential pass over columns."""

    def advance(self, *columns):
        *features, y = columns
        return super().advance(np.column_stack(features), y)


def sequential_pass(rows, states=None):
    """Predictions, residuals and drifts of unscored rows with a positive headway, and the final states."""
    ready = online_features(positive_headway(unscored(rows)))
    return in_order(
        ready, [*FEATURES, "headway_sec"], lambda saved: _Scoring.from_json(saved) if saved else _Scoring(),
        _SEQUENCE, states, carry=["hour"])


def score_rows(rows, states=None, tail=None, tree_chunk=TREE_CHUNK_ROWS, history_chunk=None):
    """Scored rows, and the sequential pass they come from (rows and final states, written once)."""
    passed = write_and_read(sequential_pass(rows, states), "sequence")
    known = passed.where("state is null").select(*SEQUENCE.fieldNames(), F.lit(True).alias("fresh"))
    if tail is not None:
        known = known.unionByName(tail.select(*SEQUENCE.fieldNames(), F.lit(False).alias("fresh")))
    scaled = ema_scale(known.withColumn("abs_residual", F.abs("residual")), "abs_residual")
    carried = [c for c in scaled.columns if c not in ("route_id", "id", "seq")]
    chunk = {"chunk_rows": history_chunk} if history_chunk else {}
    calibrated = residual_quantiles(scaled, "abs_residual", carry=carried, **chunk)
    scored = with_scores(tree_scores(calibrated, tree_chunk)).where("fresh")
    return scored.drop("fresh", "abs_residual", "hour"), passed


def with_scores(learned):
    """Score components and the composite from the learned columns, natively."""
    residual, predicted = F.col("residual"), F.col("predicted_headway_sec")
    return learned.withColumns({
        "ssl_score": ssl_residual_score(residual, F.col("history_n"), F.col("q50"), F.col("q99"), F.col("ema")),
        "relative_error": relative_error(residual, predicted),
    }).withColumn(
        "anomaly_score", composite_score(F.col("ssl_score"), F.col("tree_score"), F.col("relative_error"))
    )


def score_online(rows, **chunks):
    """Score every unscored row with a positive headway."""
    return score_rows(rows, **chunks)[0]


def tail_rows(passed, tail=None):
    """The last rows of each route that a later batch looks back on: its residual history and tree blocks."""
    rows = passed.where("state is null").select(*SEQUENCE.fieldNames())
    if tail is not None:
        rows = rows.unionByName(tail.select(*SEQUENCE.fieldNames()))
    back = RESIDUAL_HISTORY + (-RESIDUAL_HISTORY) % SCORING_BATCH + SCORING_BATCH
    last = rows.groupBy("route_id").agg((F.floor(F.max("seq") / SCORING_BATCH) * SCORING_BATCH - back).alias("_from"))
    return rows.join(last, "route_id").where(F.col("seq") >= F.col("_from")).drop("_from")


def route_states(passed, scored, states=None):
    """State of each route: rows_seen, mae_ema, drift_events and the saved text."""
    ema = scored.groupBy("route_id").agg(F.max_by("ema", "seq").alias("mae_ema"))
    final = passed.where("state is not null").select(
        "route_id", F.get_json_object("state", "$.seen").cast("long").alias("rows_seen"),
        F.get_json_object("state", "$.epoch").cast("long").alias("drift_events"), "state")
    joined = final.join(ema, "route_id", "left")
    if states is not None:
        joined = joined.join(states.select("route_id", F.col("mae_ema").alias("_old")), "route_id", "left").withColumn(
            "mae_ema", F.coalesce("mae_ema", "_old"))
    return joined.select("route_id", "rows_seen", F.coalesce("mae_ema", F.lit(0.0)).alias("mae_ema"), "drift_events", "state")


def learner_states(rows):
    """(states, tail) at the end of each route."""
    scored, passed = score_rows(rows)
    return route_states(passed, scored), tail_rows(passed)


class _Regression(PassiveAggressive):
    def advance(self, *columns):
        *features, y = columns
        predicted = []
        for x, target in zip(np.column_stack(features).tolist(), y.tolist()):
            predicted.append(self.predict(x) or target)
            self.learn(x, target)
        return {"predicted_headway_sec": predicted, "residual": y - np.array(predicted)}

    def to_json(self):
        return "{}"


def online_headway_regression(rows):
    """Predict-then-learn regression alone, without drift resets."""
    found = in_order(
        online_features(positive_headway(rows)), [*FEATURES, "headway_sec"], lambda saved: _Regression(),
        "predicted_headway_sec double, residual double")
    return number_by_route(found.where("state is null"), "predicted_headway_sec", "residual")


def tree_scores(rows, chunk_rows=TREE_CHUNK_ROWS):
    """Tree-mass score of (residual, hour) in order of ``epoch_seq`` within (route_id, epoch).

    A row is scored against the masses of the block before its own, so chunks that are multiples of the block
    and a run-up of one block give exact scores. Other columns are passed through.
    """
    if chunk_rows % TREE_BLOCK:
        raise ValueError(f"chunk_rows must be a multiple of {TREE_BLOCK}")
    names = rows.columns
    chunks = replay_chunks(rows, "epoch_seq", chunk_rows, TREE_BLOCK)

    def per_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("epoch_seq", ignore_index=True)
        # A tail may begin within a block; what precedes its first whole block is only history.
        skipped = int(-pdf["epoch_seq"].iloc[0] % TREE_BLOCK)
        scores = np.zeros(len(pdf))
        scores[skipped:] = HalfSpaceTrees().advance(pdf["residual"].to_numpy()[skipped:], pdf["hour"].to_numpy()[skipped:])
        return pdf[names].assign(tree_score=scores)[pdf["live"]]

    schema = T.StructType([*rows.schema.fields, T.StructField("tree_score", T.DoubleType())])
    return chunks.groupBy("route_id", "epoch", "chunk").applyInPandas(per_chunk, schema)


def half_space_trees(rows, chunk_rows=TREE_CHUNK_ROWS):
    """Tree-mass score of (residual, hour) in observation order per route, without drifts."""
    ready = online_features(rows.where(F.col("residual").isNotNull()))
    numbered = number_by_route(ready, "residual", "hour")
    return tree_scores(numbered.withColumns({"epoch": F.lit(0).cast("long"), "epoch_seq": F.col("seq")}), chunk_rows)


class _Drift(AdaptiveWindow):
    epoch = 0

    def advance(self, residual):
        sizes = np.minimum(np.abs(residual) / RESIDUAL_SPAN, 1.0)
        drifted = np.array([self.add(v) for v in sizes.tolist()], dtype=bool)
        before = self.epoch + np.cumsum(drifted) - drifted
        self.epoch += int(drifted.sum())
        return {"drifted": drifted, "epoch": before}

    def to_json(self):
        return "{}"


def drift_adwin(rows):
    """Adaptive-window detection on the absolute residual; ``epoch`` counts the drifts before a row."""
    found = in_order(
        rows.where(F.col("residual").isNotNull()), ["residual"], lambda saved: _Drift(), "drifted boolean, epoch long")
    return number_by_route(found.where("state is null"), "drifted", "epoch")


def telemetry_online(scored_rows, backlog, last_run_utc, batch_limit=SCORING_BATCH):
    """One-row learner telemetry.

    The quantiles are those of the newest row that had enough history and a residual; the averaged error is
    that of the newest row; the last batch is what was left of the queue for it. ``backlog`` is a one-row
    table, ``last_run_utc`` a Column.
    """
    newest = F.struct("observed_ts", "id")
    calibrated = (F.col("history_n") >= RESIDUAL_HISTORY_MIN) & (F.col("residual") != 0)
    told = lambda name: F.max_by(
        F.when(calibrated & (F.col(name) > 0), F.col(name)), F.when(calibrated & (F.col(name) > 0), newest))
    zero = lambda column: F.coalesce(column, F.lit(0.0))
    n = F.count(F.lit(1))
    return scored_rows.agg(
        n.alias("rows_seen"),
        n.alias("rows_updated"),
        F.count_if("drifted").alias("drift_events"),
        zero(F.max_by("ema", newest)).alias("mae_ema"),
        zero(told("q90")).alias("residual_q90"),
        zero(told("q99")).alias("residual_q99"),
        F.when(n > 0, (n - 1) % batch_limit + 1).otherwise(0).cast("long").alias("last_batch_processed"),
        F.max(backlog.scalar()).alias("unscored_backlog"),
        F.max(last_run_utc).alias("last_run_utc"),
    )
