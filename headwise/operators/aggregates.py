"""Grouped and whole-table aggregates."""
from pyspark.sql import functions as F

from headwise.functions.clock import hour_utc
from headwise.functions.scoring import clamp_score, severity_band
from headwise.operators.filters import is_scored, is_unscored, positive_headway, recent_window_filter
from headwise.operators.quantiles import exact_median_mad, exact_quantiles
from headwise.schema import ANOMALY_SCORE, HIGH_ANOMALY_SCORE


def earliest_arrival(arrivals):
    """Earliest arrival per key within one feed poll (partial plus final hash aggregate)."""
    return arrivals.groupBy("poll_ts", "feed", "route_id", "stop_id").agg(
        F.min("arrival").alias("arrival")
    )


def headway_median_mad(rows):
    """Median and median absolute deviation of positive headways per route, stop, UTC hour."""
    keys = ["route_id", "stop_id", "hour"]
    rows = positive_headway(rows).withColumn("hour", hour_utc(F.col("observed_ts")))
    return exact_median_mad(rows, keys, "headway_sec")


def window_counts(scores):
    """All dashboard counts in one pass.

    Rows are first folded to (route, stop), which combines on the map side;
    the distinct counts then run over that small table instead of expanding
    every input row once per distinct aggregate.
    """
    scored = is_scored()
    per_pair = scores.groupBy("route_id", "stop_id").agg(
        F.count_if(scored).alias("_scored"),
        F.count_if(scored & (F.col("headway_sec") > 0)).alias("_active"),
        F.count_if(scored & (F.col("anomaly_score") >= ANOMALY_SCORE)).alias("_anomalies"),
        F.count_if(scored & (F.col("anomaly_score") >= HIGH_ANOMALY_SCORE)).alias("_high"),
    )
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("long")
    counts = per_pair.agg(
        F.count_distinct(F.when(F.col("_scored") > 0, F.col("stop_id"))).alias("stations_total"),
        F.count_if(F.col("_active") > 0).alias("trains_active"),
        total("_anomalies").alias("anomalies_count"),
        total("_high").alias("anomalies_high"),
        total("_scored").alias("scored_rows"),
    )
    return counts.withColumn("anomaly_rate_perc", anomaly_rate(F.col("anomalies_count"), F.col("scored_rows")))


def anomaly_rate(anomalies, total):
    return F.when(total > 0, F.round(anomalies / total * 100.0, 2)).otherwise(F.lit(0.0))


def count_scored(scores):
    return scores.agg(F.count_if(is_scored()).alias("scored_rows"))


def count_distinct_stops(scores):
    return scores.where(is_scored()).agg(F.count_distinct("stop_id").alias("stations_total"))


def count_distinct_route_stop(scores):
    live = scores.where(is_scored() & (F.col("headway_sec") > 0))
    return live.agg(F.count_distinct(F.struct("route_id", "stop_id")).alias("trains_active"))


def conditional_counts(scores):
    counts = scores.where(is_scored()).agg(
        F.count(F.lit(1)).alias("scored_rows"),
        F.count_if(F.col("anomaly_score") >= ANOMALY_SCORE).alias("anomalies_count"),
        F.count_if(F.col("anomaly_score") >= HIGH_ANOMALY_SCORE).alias("anomalies_high"),
    )
    return counts.withColumn("anomaly_rate_perc", anomaly_rate(F.col("anomalies_count"), F.col("scored_rows")))


def max_observed(scores):
    return scores.agg(F.max("observed_ts").alias("last_observed"))


def unscored_backlog(scores):
    return scores.agg(F.count_if(is_unscored()).alias("unscored_backlog"))


def readiness_counts(scores):
    return scores.agg(
        F.count(F.lit(1)).alias("scores_total"),
        F.count("headway_sec").alias("headway_ready"),
        F.count("predicted_headway_sec").alias("scored_rows"),
    )


def band_counts(scores):
    banded = scores.select(
        severity_band(F.col("anomaly_score")).alias("band"), clamp_score(F.col("anomaly_score")).alias("score")
    )
    return banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score")
    )


def error_quantiles(errors, column="err"):
    """p90, p99, maximum, and how many errors reach p99, over all rows."""
    limits = exact_quantiles(errors, [], column, [0.9, 0.99]).select("quantiles").scalar()
    limited = errors.withColumn("_limits", limits)
    return limited.agg(
        F.max(F.col("_limits")[0]).alias("recon_error_p90"),
        F.max(F.col("_limits")[1]).alias("recon_error_p99"),
        F.max(column).alias("recon_error_max"),
        F.count_if(F.col(column) >= F.col("_limits")[1]).alias("shadow_alerts_high"),
    )


def score_correlation(errors, column="err", score="online_score"):
    """Pearson correlation; 0 when either side is constant.

    Built from the covariance: ``corr`` itself divides by zero on a constant side.
    """
    spread = lambda name: F.coalesce(F.stddev_pop(name), F.lit(0.0))
    varies = (spread(column) > 1e-8) & (spread(score) > 1e-8)
    product = F.nullif(spread(column) * spread(score), F.lit(0.0))
    correlation = F.when(varies, F.covar_pop(column, score) / product)
    return errors.agg(F.coalesce(correlation, F.lit(0.0)).alias("corr_with_online_score"))


def distinct_routes(scores, static_routes, as_of=None):
    """Routes seen in the last 24 hours; the static list only if there are none."""
    blank = F.trim("route_id") == ""
    seen = recent_window_filter(scores, "24h", as_of).where(~blank).select("route_id").distinct()
    fallback = static_routes.where(~blank).select("route_id").distinct()
    none_seen = seen.agg((F.count(F.lit(1)) == 0)).scalar()
    return seen.unionByName(fallback.where(none_seen))
