"""Ordered limits. Each is a top-k per partition plus one merge, and every
ordering ends in ``id`` so that results are deterministic."""
from pyspark.sql import Window, functions as F

from headwise.operators.filters import positive_headway, recent_window_filter, scored, unscored
from headwise.params import bounded


def _worst_first():
    return [F.desc("anomaly_score"), F.desc("observed_ts"), F.desc("id")]


def top_anomalies(scores, limit=300):
    bounded("limit", limit, 20, 1000)
    return scores.orderBy(*_worst_first()).limit(limit)


def fifo_unscored_batch(scores, limit=1024):
    """Oldest unscored rows with a usable headway."""
    return positive_headway(unscored(scores)).orderBy("observed_ts", "id").limit(max(64, limit))


def recent_scored_sample(scores, limit=18_000, window_minutes=240, as_of=None):
    """Newest scored rows of the window, returned oldest first."""
    recent = recent_window_filter(scores, f"{max(5, window_minutes)}m", as_of)
    rows = scored(recent.where(F.col("headway_sec").isNotNull()))
    newest = rows.orderBy(F.desc("observed_ts"), F.desc("id")).limit(max(256, limit))
    return newest.orderBy("observed_ts", "id")


def top_error_events(errors, k=5):
    """Rows with the largest reconstruction error. The stop id doubles as its name."""
    return (
        errors.orderBy(F.desc("err"), F.desc("id")).limit(k)
        .select(
            "route_id", "stop_id", F.col("stop_id").alias("stop_name"),
            F.round("err", 6).alias("dl_error"), F.round("online_score", 6).alias("online_score"),
        )
    )


def anomaly_page(ranked, page=1, page_size=20):
    """One page of an already limited ranking; a page past the end is the last page.

    The ranking has at most its limit of rows, so one window numbers and counts it.
    """
    order = Window.orderBy(*_worst_first())
    numbered = ranked.withColumns({
        "_rank": F.row_number().over(order),
        "_n": F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    last = F.greatest(F.ceil(F.col("_n") / page_size), F.lit(1))
    start = (F.least(F.lit(max(1, page)), last) - 1) * page_size
    return numbered.where((F.col("_rank") > start) & (F.col("_rank") <= start + page_size)).orderBy("_rank").drop("_rank", "_n")
