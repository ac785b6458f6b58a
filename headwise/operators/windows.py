"""Ordered per-key computations."""
import pandas as pd
from pyspark.sql import Window, functions as F, types as T

from headwise.operators.rolling import history_quantiles
from headwise.operators.sequence import replay_chunks
from headwise.schema import EMA_KEEP, EMA_TAKE, FEEDS, RESIDUAL_HISTORY, SCORING_BATCH, plain_fields

CHUNK_ROWS = 65_536


def lag_by_slice(rows, keys, order, value, slice_column, out):
    """Previous value of each key, with the key cut into slices.

    Inside a slice this is an ordinary ``lag``; the first row of a slice takes
    the last value of the key's previous non-empty slice. A hot key therefore
    spreads over as many tasks as it has slices.
    """
    local = Window.partitionBy(*keys, slice_column).orderBy(*order)
    rows = rows.withColumn("_lag", F.lag(value).over(local)).withColumn("_pos", F.row_number().over(local))
    tails = rows.groupBy(*keys, slice_column).agg(
        F.max_by(F.col(value), F.col("_pos")).alias("_tail")
    )
    across = Window.partitionBy(*keys).orderBy(slice_column)
    carry = tails.select(*keys, slice_column, F.lag("_tail").over(across).alias("_carry"))
    joined = rows.join(carry, [*keys, slice_column], "left")
    return joined.withColumn(
        out, F.when(F.col("_pos") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    ).drop("_lag", "_pos", "_carry")


def feed_order(feed):
    """Position of a feed in the polling order."""
    return F.array_position(F.array(*[F.lit(f) for f in FEEDS]), feed)


def headway_lag(earliest):
    """Headway of each (route, stop) between consecutive polls.

    The remembered arrival moves even when it went backwards; only a forward
    step yields a headway. Input has one row per poll, feed and key.
    """
    ordered = earliest.withColumn("feed_ord", feed_order(F.col("feed"))).withColumn(
        "_day", F.to_date("poll_ts")
    )
    lagged = lag_by_slice(
        # ``feed`` decides between unlisted feeds, and makes both branches read the same shuffle.
        ordered, ["route_id", "stop_id"], ["poll_ts", "feed_ord", "feed"], "arrival", "_day", "prev_arrival"
    )
    step = F.col("arrival") - F.col("prev_arrival")
    return lagged.withColumn("headway_sec", F.when(step > 0, step.cast("double"))).drop("_day")


def top1_per_stop(scores):
    """Worst row per stop. Spark limits each group before and after the shuffle."""
    ranked = Window.partitionBy("stop_id").orderBy(
        F.desc("anomaly_score"), F.desc("observed_ts"), F.desc("id")
    )
    return scores.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def ema_scale(numbered, value, key="route_id", block_rows=SCORING_BATCH):
    """Exponential average (first value, then 0.92 old + 0.08 new) per key.

    The recurrence is linear, so blocks are computed independently and the
    value at the end of the previous block is carried in. Two full blocks back
    weighs 0.92^1024 < 1e-37, below double precision, so one carry is exact.
    """
    if block_rows < SCORING_BATCH:
        raise ValueError(f"block_rows must be at least {SCORING_BATCH}")
    rows = numbered.withColumn("_block", F.floor(F.col("seq") / block_rows).cast("long"))
    rows = rows.withColumn("_j", (F.col("seq") % block_rows).cast("double"))
    first = F.when(F.col("seq") == 0, F.lit(1.0)).otherwise(F.lit(EMA_TAKE))
    running = F.sum(first * F.col(value) * F.pow(F.lit(EMA_KEEP), -F.col("_j"))).over(
        Window.partitionBy(key, "_block").orderBy("seq")
    )
    rows = rows.withColumn("_local", running * F.pow(F.lit(EMA_KEEP), F.col("_j")))
    carries = rows.groupBy(key, (F.col("_block") + 1).alias("_block")).agg(
        F.max_by("_local", "_j").alias("_carry")
    )
    joined = rows.join(carries, [key, "_block"], "left")
    carried = F.coalesce(F.col("_carry"), F.lit(0.0)) * F.pow(F.lit(EMA_KEEP), F.col("_j") + 1)
    return joined.withColumn("ema", F.col("_local") + carried).drop("_block", "_j", "_local", "_carry")


def residual_quantiles(numbered, value, key="route_id", chunk_rows=CHUNK_ROWS, carry=()):
    """q50, q90, q99 and the size of the residual history before each row.

    The history is what the scorer keeps: the last 8000 values at the start of
    the row's batch of 1024, plus the earlier rows of that batch. Columns in
    ``carry`` are passed through.
    """
    warmup = RESIDUAL_HISTORY + (-RESIDUAL_HISTORY) % SCORING_BATCH
    if chunk_rows % SCORING_BATCH:
        raise ValueError(f"chunk_rows must be a multiple of {SCORING_BATCH}")
    kept = numbered.select(key, "id", "seq", *carry)
    names = kept.columns
    chunks = replay_chunks(numbered.select(*names, F.col(value).alias("_x")), "seq", chunk_rows, warmup)

    def per_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        sizes, found = history_quantiles(pdf["_x"].to_numpy(), pdf["seq"].to_numpy(), (0.5, 0.9, 0.99))
        out = pdf[names].assign(history_n=sizes, **dict(zip(("q50", "q90", "q99"), found)))
        return out[pdf["live"]]

    added = plain_fields("history_n long, q50 double, q90 double, q99 double")
    return chunks.groupBy(key, "chunk").applyInPandas(per_chunk, T.StructType([*kept.schema.fields, *added]))
