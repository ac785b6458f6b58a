"""Self-supervised shadow detector: features, standardisation, training, telemetry."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from headwise.functions.clock import cyclic_time
from headwise.functions.hashing import stable_hash_unit
from headwise.operators import autoencoder
from headwise.operators.aggregates import error_quantiles, score_correlation
from headwise.operators.ranking import top_error_events
from headwise.schema import ROUTE_HASH_MOD, STOP_HASH_MOD
from headwise.session import write_and_read

# Feature order of the matrix.
FEATURES = [
    "headway_sec", "predicted_headway_sec", "residual", "online_score",
    "hour_sin", "hour_cos", "minute_sin", "minute_cos", "route_hash", "stop_hash",
]
# Rows needed for training, and the published model name.
MIN_ROWS = 256
MODEL_NAME = "denoising_autoencoder_v1"

# An epoch is this many steps. The mini-batch of a step is a fixed share of the rows, chosen by a hash of their id, so
# it grows with the data and neither steps nor results depend on partitions. A task holds one block of rows.
STEPS = 8
BLOCK_ROWS = 8192


def shadow_features(scored_rows):
    """The ten features of each scored row, beside its identity."""
    ts = F.col("observed_ts")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    return scored_rows.select(
        "id", "observed_ts", "route_id", "stop_id", "headway_sec", "predicted_headway_sec",
        zero("residual").alias("residual"), zero("anomaly_score").alias("online_score"),
        *cyclic_time(ts),
        stable_hash_unit(F.col("route_id"), ROUTE_HASH_MOD).alias("route_hash"),
        stable_hash_unit(F.col("stop_id"), STOP_HASH_MOD).alias("stop_hash"),
    )


def training_table(scored_rows):
    """Features materialised once (training reads them several times) and their count."""
    features = write_and_read(shadow_features(scored_rows), "shadow-features")
    return features, features.count()


def standardise_matrix(features):
    """z-scores with the population deviation; a constant feature is divided by 1.

    The statistics are one row, handed back to the rows as a scalar subquery.
    """
    stats = features.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in FEATURES
    ]).alias("stats")).scalar()
    with_stats = features.withColumn("_s", stats)
    z = lambda c: (F.col(c) - F.col(f"_s.{c}.mean")) / F.when(
        F.col(f"_s.{c}.std") < 1e-6, F.lit(1.0)
    ).otherwise(F.col(f"_s.{c}.std"))
    return with_stats.select(
        "id", "observed_ts", "route_id", "stop_id", F.col("online_score").alias("score"),
        *[z(c).alias(c) for c in FEATURES],
    )


def _batch_gradient(batch, weights, seed):
    """(rows, summed loss, summed gradient) of a mini-batch, or None without rows.

    Every task adds up its own rows; the partial sums, a vector of about 2500 numbers per task, are added by place,
    and only their total reaches the driver.
    """
    def partial(frames):
        total = np.zeros(len(weights) + 2)
        for frame in frames:
            x, keys = frame[FEATURES].to_numpy(dtype=float), frame["key"].to_numpy()
            for at in range(0, len(x), BLOCK_ROWS):
                block = x[at:at + BLOCK_ROWS]
                loss, grad = autoencoder.gradient(weights, autoencoder.corrupt(block, keys[at:at + BLOCK_ROWS], seed), block)
                total += len(block) * np.concatenate([[1.0, loss], grad])
        if total[0]:
            yield pd.DataFrame({"sums": [total]})

    parts = batch.select("key", *FEATURES).mapInPandas(partial, "sums array<double>")
    sums = parts.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    if not len(sums):
        return None
    rows, loss, *grad = sums.sort_values("i")["x"]
    return rows, loss, np.array(grad)


def shadow_autoencoder(matrix, weights=None, epochs=autoencoder.EPOCHS, seed=7, steps=STEPS):
    """Train over all rows of a standardised matrix and score each row.

    Returns (rows with ``err``, weights, mean loss of the last epoch). ``weights`` of an earlier run give a warm start.
    Training is batch-synchronous: each step sums the gradient of its mini-batch over all tasks and moves the weights
    once. The matrix is written once, in a folder per step, and each epoch reads every row once. Noise and masks are
    drawn from a row's id, so weights are equal for any number of partitions, up to the rounding of sums.
    """
    if weights is None or len(weights) != len(autoencoder.initial_weights()):
        weights = autoencoder.initial_weights(seed)
    learner, loss = autoencoder.Adam(weights), 0.0
    keyed = matrix.withColumn("key", F.xxhash64("id"))
    stored = write_and_read(keyed.withColumn("step", F.pmod("key", F.lit(steps)).cast("int")), "shadow-matrix", ["step"])
    for epoch in range(max(1, epochs)):
        seen = lost = 0.0
        for step in range(steps):
            sums = _batch_gradient(stored.where(F.col("step") == step), learner.flat, seed + epoch)
            if sums:
                learner.step(sums[2] / sums[0])
                seen, lost = seen + sums[0], lost + sums[1]
        loss = lost / seen if seen else 0.0
    weights = learner.flat

    identity = ["id", "observed_ts", "route_id", "stop_id", "score"]

    def score(frames):
        for frame in frames:
            out = frame[identity].rename(columns={"score": "online_score"})
            out["err"] = autoencoder.row_errors(weights, frame[FEATURES].to_numpy())
            yield out

    schema = "id long, observed_ts timestamp, route_id string, stop_id string, online_score double, err double"
    return stored.select(*identity, *FEATURES).mapInPandas(score, schema), weights, loss


# Names of the published telemetry, here and in ``run_shadow``.
def _telemetry_without_training(spark, samples, last_run_utc):
    events = "array<struct<route_id:string,stop_id:string,stop_name:string,dl_error:double,online_score:double>>"
    zeros = ("loss_last", "recon_error_p90", "recon_error_p99", "recon_error_max")
    return spark.range(1).select(
        F.lit("unavailable").alias("status"), F.lit(MODEL_NAME).alias("model"), F.lit("cpu").alias("device"),
        F.lit(samples).cast("long").alias("samples_used"), F.lit(0).alias("train_epochs"),
        *[F.lit(0.0).alias(c) for c in zeros],
        F.lit(0).cast("long").alias("shadow_alerts_high"), F.lit(0.0).alias("corr_with_online_score"),
        F.array().cast(events).alias("top_shadow_events"), last_run_utc.alias("last_run_utc"),
        F.lit("insufficient_scored_rows").alias("note"),
    )


def run_shadow(scored_rows, last_run_utc, weights=None, epochs=autoencoder.EPOCHS):
    """(one-row telemetry, trained weights); weights are None with too few rows."""
    features, samples = training_table(scored_rows)
    if samples < MIN_ROWS:
        return _telemetry_without_training(features.sparkSession, samples, last_run_utc), None
    errors, weights, loss = shadow_autoencoder(standardise_matrix(features), weights, epochs)
    # Errors are read several times below; the model must not run again for each.
    errors = write_and_read(errors, "shadow-errors")
    worst_first = F.reverse(F.array_sort(F.collect_list(
        F.struct("dl_error", "route_id", "stop_id", "stop_name", "online_score")
    )))
    top_events = top_error_events(errors).agg(
        F.transform(worst_first, lambda e: F.struct(
            *[e[c].alias(c) for c in ("route_id", "stop_id", "stop_name", "dl_error", "online_score")]
        )).alias("top")
    ).scalar()
    telemetry = error_quantiles(errors).select(
        F.lit("available").alias("status"), F.lit(MODEL_NAME).alias("model"), F.lit("cpu").alias("device"),
        F.lit(samples).cast("long").alias("samples_used"), F.lit(max(1, epochs)).alias("train_epochs"),
        F.lit(float(loss)).alias("loss_last"),
        "recon_error_p90", "recon_error_p99", "recon_error_max", "shadow_alerts_high",
        score_correlation(errors).scalar().alias("corr_with_online_score"),
        top_events.alias("top_shadow_events"), last_run_utc.alias("last_run_utc"),
        F.lit(None).cast("string").alias("note"),
    )
    return telemetry, weights


def telemetry_shadow(scored_rows, last_run_utc, **options):
    """One-row shadow telemetry over the given scored rows."""
    return run_shadow(scored_rows, last_run_utc, **options)[0]
