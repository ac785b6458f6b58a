"""The served dashboard queries, composed from the operators."""
from pyspark.sql import functions as F

from headwise.functions.clock import hour_utc, ts_pack, utc_text
from headwise.functions.geo import event_feature
from headwise.functions.hashing import set_fingerprint
from headwise.operators.aggregates import distinct_routes, headway_median_mad, window_counts
from headwise.operators.filters import (
    min_score_filter, positive_headway, recent_window_filter, route_filter, scored,
)
from headwise.operators.joins import features_join_stats, stop_geo_inner_join, stop_name_left_join
from headwise.operators.ranking import recent_scored_sample, top_anomalies
from headwise.operators.shadow import shadow_features
from headwise.operators.windows import top1_per_stop
from headwise.params import instant, newest

FRESH_SEC = 900


def summary(scores, window="15m", as_of=None):
    """Dashboard counts of a window. ``last_updated`` looks at the whole table."""
    counts = window_counts(recent_window_filter(scores, window, as_of))
    fallback = F.current_timestamp() if as_of is None else instant(as_of, scores)
    return (
        counts.withColumn("_updated", F.coalesce(newest(scores), fallback))
        .select(
            F.lit(window).alias("window"), "stations_total", "trains_active", "anomalies_count",
            "anomalies_high", "anomaly_rate_perc", "scored_rows",
            *ts_pack(F.col("_updated"), "last_updated"),
        )
        .withColumnsRenamed({
            "last_updated_ts_utc": "last_updated_utc",
            "last_updated_ts_epoch_ms": "last_updated_epoch_ms",
            "last_updated_ts_ny": "last_updated_ny",
        })
    )


def anomalies(scores, stops, window="15m", as_of=None, route_id="All", min_score=0.0, limit=300):
    """Ranked anomalies with stop names and both timestamps."""
    rows = scored(recent_window_filter(scores, window, as_of))
    rows = min_score_filter(route_filter(rows, route_id), min_score)
    named = stop_name_left_join(top_anomalies(rows, limit), stops)
    return named.orderBy(F.desc("anomaly_score"), F.desc("observed_ts"), F.desc("id")).select(
        "route_id", "stop_id", "stop_name", "headway_sec", "predicted_headway_sec", "anomaly_score", "residual",
        *ts_pack(F.col("observed_ts"), "observed"), *ts_pack(F.col("event_ts"), "event"),
    )


def heatmap(scores, stops, window="60m", as_of=None, route_id="All"):
    """Worst event per stop with geometry; ``feature`` is the GeoJSON text."""
    rows = scored(recent_window_filter(scores, window, as_of, closed=True, default_minutes=60))
    located = stop_geo_inner_join(top1_per_stop(route_filter(rows, route_id)), stops)
    packed = located.select(
        "*", *ts_pack(F.col("observed_ts"), "observed"), *ts_pack(F.col("event_ts"), "event")
    )
    return event_feature(packed).select(
        "stop_id", "stop_name", "route_id", "lon", "lat", "anomaly_score", "residual", "headway_sec",
        "predicted_headway_sec", "observed_ts_utc", "observed_ts_epoch_ms", "observed_ts_ny",
        "event_ts_utc", "event_ts_epoch_ms", "event_ts_ny", "feature",
    )


def routes(scores, static_routes, as_of=None):
    return distinct_routes(scores, static_routes, as_of).orderBy("route_id")


def routes_fingerprint(scores, static_routes, as_of=None):
    return set_fingerprint(distinct_routes(scores, static_routes, as_of), "route_id")


def _health(document, name):
    """Status and payload of a telemetry document; one nobody wrote is unavailable."""
    if document is None:
        return F.lit("unavailable").alias(f"{name}_status"), F.lit(None).cast("string").alias(f"{name}_telemetry")
    fields = [F.col(c) for c in document.columns if c != "status"]
    known = F.when(F.col("status") == "available", F.to_json(F.struct(*fields)))
    return document.select("status").scalar().alias(f"{name}_status"), document.select(known).scalar().alias(f"{name}_telemetry")


def freshness(scores, stops, as_of=None, model=None, shadow=None):
    """Totals, age of the newest row, the telemetry documents of model and shadow, and the overall status.

    ``model`` and ``shadow`` are one-row documents as ``telemetry_read`` and ``shadow_health_read`` give them.
    """
    now = F.current_timestamp() if as_of is None else instant(as_of, scores)
    recent = F.count_if(F.col("observed_ts") >= now - F.expr(f"INTERVAL '{FRESH_SEC}' SECOND"))
    totals = scores.agg(
        F.count(F.lit(1)).alias("scores_total"), recent.alias("scores_recent_15m"),
        F.max("observed_ts").alias("_last"), F.max(now).alias("_now"),
    )
    age = F.floor((F.unix_micros(F.coalesce("_now", now)) - F.unix_micros("_last")) / 1_000_000).cast("long")
    checked = totals.withColumn("last_observed_age_sec", age).withColumn(
        "fresh", F.coalesce(F.col("last_observed_age_sec") <= FRESH_SEC, F.lit(False))
    ).withColumn("stops_count", stops.agg(F.count(F.lit(1))).scalar()).select(
        "*", *_health(model, "model"), *_health(shadow, "shadow"))
    broken = (F.col("model_status") == "error") | (F.col("shadow_status") == "error")
    healthy = F.col("fresh") & (F.col("stops_count") > 0) & ~broken
    return checked.select(
        F.when(healthy, "ok").otherwise("degraded").alias("status"),
        "scores_total", "scores_recent_15m", *ts_pack(F.col("_last"), "last_observed"), "last_observed_age_sec", "fresh",
        "stops_count", "model_status", "shadow_status", "model_telemetry", "shadow_telemetry",
    )


def features_batch(scores, window="5m", as_of=None):
    """Recent positive headways beside the robust statistics of their group."""
    recent = positive_headway(recent_window_filter(scores, window, as_of))
    rows = recent.withColumn("hour", hour_utc(F.col("observed_ts")))
    return features_join_stats(rows, headway_median_mad(recent)).select(
        "id", "route_id", "stop_id", "hour", "headway_sec", "median", "mad"
    )


def shadow_sample(scores, limit=18_000, window_minutes=240, as_of=None):
    return shadow_features(recent_scored_sample(scores, limit, window_minutes, as_of))


def run_stamp(as_of):
    """UTC text of a run instant, for telemetry."""
    return utc_text(as_of)
