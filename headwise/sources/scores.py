"""The scores table: append, and set-based update of scored rows."""
from pyspark.sql import functions as F, types as T

from headwise.operators.sequence import number_rows
from headwise.schema import DEFAULT_WINDOW_SEC, SCORES
from headwise.session import work_path


def as_scores(headways, first_id=0):
    """Headway rows as new, unscored scores rows with dense ids.

    Rows are numbered in poll order, so a repeated run gives the same ids, and
    each poll of a feed is numbered apart.
    """
    rows = headways.select(
        F.lit(0).alias("_all"), F.col("poll_ts").alias("observed_ts"), "feed_ord", "feed",
        F.timestamp_seconds("arrival").alias("event_ts"), "route_id", "stop_id", "headway_sec",
    )
    # ``feed`` tells unlisted feeds apart, which share a place in the polling order.
    polls = ["observed_ts", "feed_ord", "feed"]
    numbered = number_rows(rows, ["_all"], [*polls, "route_id", "stop_id"], polls)
    return numbered.select(
        (F.col("seq") + F.lit(first_id)).cast("long").alias("id"),
        "observed_ts", "event_ts", "route_id", "stop_id", "headway_sec",
        F.lit(None).cast("double").alias("predicted_headway_sec"),
        F.lit(0.0).alias("anomaly_score"),
        F.lit(None).cast("double").alias("residual"),
        F.lit(DEFAULT_WINDOW_SEC).alias("window_sec"),
    )


def _write_by_date(rows, path):
    """Dynamic overwrite of (observed_date, batch_id). The sort starts with the
    partition columns, so files stay in time order and keep tight statistics."""
    (
        rows.sortWithinPartitions("observed_date", "batch_id", "observed_ts", "id")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("observed_date", "batch_id").parquet(path)
    )


def append_scores(rows, path, batch_id=0, clustered=False):
    """Append one batch, partitioned by observation date and batch.

    Writing the same batch again replaces its own partitions only, which makes
    a retried micro-batch harmless. Rows not yet ``clustered`` by time are range
    partitioned first: a busy date is split over tasks, a quiet one is not.
    """
    if not clustered:
        rows = rows.repartitionByRange("observed_ts", "id")
    _write_by_date(
        rows.withColumn("observed_date", F.to_date("observed_ts"))
        .withColumn("batch_id", F.lit(int(batch_id)).cast("long")),
        path,
    )


def read_scores(spark, path):
    stored = T.StructType(SCORES.fields + [
        T.StructField("observed_date", T.DateType()), T.StructField("batch_id", T.LongType()),
    ])
    return spark.read.schema(stored).parquet(path)


def scores_update(base, scored):
    """Base rows with predictions filled in by id; unknown ids change nothing."""
    fresh = scored.select(
        "id", F.col("predicted_headway_sec").alias("_p"), F.col("residual").alias("_r"),
        F.col("anomaly_score").alias("_s"),
    )
    hit = F.col("_p").isNotNull()
    window = F.coalesce(F.nullif(F.col("window_sec"), F.lit(0)), F.lit(DEFAULT_WINDOW_SEC))
    updated = {
        "predicted_headway_sec": F.when(hit, F.col("_p")).otherwise(F.col("predicted_headway_sec")),
        "residual": F.when(hit, F.col("_r")).otherwise(F.col("residual")),
        "anomaly_score": F.when(hit, F.col("_s")).otherwise(F.col("anomaly_score")),
        "window_sec": F.when(hit, window).otherwise(F.col("window_sec")),
    }
    return base.join(fresh, "id", "left").select(
        *[updated.get(c, F.col(c)).alias(c) for c in base.columns]
    )


def rewrite_scores(spark, path, scored):
    """Apply an update to a stored table, rewriting only the dates it touches.

    ``scored`` carries ``observed_ts``. The merged dates are staged first, so
    the table is never read and overwritten by one and the same job.
    """
    dates = scored.select(F.to_date("observed_ts").alias("observed_date")).distinct()
    first, last = (dates.agg(f("observed_date")).scalar() for f in (F.min, F.max))
    stored = read_scores(spark, path)
    # The bounds prune partitions before the scan; the semi join then drops gaps.
    near = stored.where(F.col("observed_date").between(first, last))
    touched = near.join(dates, "observed_date", "left_semi").select(*stored.columns)
    staged = work_path(spark, "scores-update")
    scores_update(touched, scored).write.partitionBy("observed_date", "batch_id").parquet(staged)
    _write_by_date(read_scores(spark, staged).repartitionByRange("observed_ts", "id"), path)
