"""The two recurring jobs: scoring the backlog, and the shadow detector."""
from pyspark.sql import functions as F

from headwise.functions.clock import utc_text
from headwise.operators.aggregates import unscored_backlog
from headwise.operators.filters import recent_window_filter, scored
from headwise.operators.online import SEQUENCE, route_states, score_rows, tail_rows, telemetry_online
from headwise.operators.ranking import fifo_unscored_batch
from headwise.operators.shadow import run_shadow
from headwise.sources.model_state import load_state, load_tail, load_weights, save_state, save_weights
from headwise.sources.scores import read_scores, rewrite_scores
from headwise.sources.telemetry import telemetry_read, telemetry_write
from headwise.session import write_and_read

def score_from_state(spark, rows, state_path, version):
    """Score rows from the newest saved state below ``version``, and save the state after them.

    Returns the scored rows, written, and the states. Repeating a version starts from the same state and
    replaces what it saved.
    """
    states = load_state(spark, state_path, version).drop("version")
    tail = load_tail(spark, state_path, SEQUENCE, version).drop("version")
    scored, passed = score_rows(rows, states, tail)
    scored = write_and_read(scored, "scored")
    # Written before they are saved: what is read here must not change meanwhile.
    new_states = write_and_read(route_states(passed, scored, states), "states")
    save_state(new_states, write_and_read(tail_rows(passed, tail), "tail"), state_path, version)
    return scored, new_states


def score_cycle(spark, scores_path, state_path, telemetry_path, now, batch_limit=1024, max_batches=4):
    """Score the oldest unscored rows and write scores, learner state and telemetry.

    ``now`` is an aware datetime and also names the saved state version.
    """
    batch_limit, max_batches = max(64, batch_limit), max(1, max_batches)
    backlog = fifo_unscored_batch(read_scores(spark, scores_path), batch_limit * max_batches)
    learned, new_states = score_from_state(spark, backlog, state_path, now.strftime("%Y%m%d%H%M%S%f"))
    before = telemetry_read(spark, telemetry_path)
    rewrite_scores(spark, scores_path, learned)
    left = unscored_backlog(read_scores(spark, scores_path))
    row = write_and_read(
        _cycle_telemetry(learned, new_states, before, left, utc_text(F.lit(now)), batch_limit), "telemetry"
    )
    telemetry_write(row, telemetry_path)
    return learned


def _cycle_telemetry(learned, states, before, left, last_run_utc, batch_limit):
    """This run's figures; values that did not advance keep the previous document's."""
    run = telemetry_online(learned, left, last_run_utc, batch_limit)
    old = lambda name: F.coalesce(before.select(name).scalar(), F.lit(0))
    n = F.col("rows_seen")
    kept = lambda name: F.when(F.col(name) > 0, F.col(name)).otherwise(old(name)).alias(name)
    total = lambda name: F.coalesce(states.agg(F.sum(name)).scalar(), F.lit(0)).cast("long").alias(name)
    return run.select(
        total("rows_seen"),
        (old("rows_updated") + n).cast("long").alias("rows_updated"),
        total("drift_events"),
        F.when(n > 0, F.col("mae_ema")).otherwise(old("mae_ema")).alias("mae_ema"),
        kept("residual_q90"), kept("residual_q99"),
        F.when(n > 0, F.col("last_batch_processed")).otherwise(old("last_batch_processed"))
        .cast("long").alias("last_batch_processed"),
        "unscored_backlog", "last_run_utc",
    )


def shadow_cycle(spark, scores_path, weights_path, telemetry_path, now, window_minutes=240, epochs=4, limit=None):
    """Train on the window's scored rows from the saved weights and publish telemetry.

    ``limit`` keeps the newest rows only, as a sampling choice; by default the
    whole window is used. Scores are never changed.
    """
    window = f"{max(5, window_minutes)}m"
    recent = scored(recent_window_filter(read_scores(spark, scores_path), window, now)).where("headway_sec is not null")
    if limit:
        recent = recent.orderBy(F.desc("observed_ts"), F.desc("id")).limit(max(256, limit))
    row, weights = run_shadow(recent, utc_text(F.lit(now)), load_weights(spark, weights_path), epochs)
    if weights is not None:
        save_weights(spark, weights, weights_path, now.strftime("%Y%m%d%H%M%S%f"))
    row = write_and_read(row, "shadow-telemetry")
    telemetry_write(row, telemetry_path)
    return row
