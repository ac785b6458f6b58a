"""Row predicates. All are plain Column filters, so they reach the scan."""
from pyspark.sql import functions as F

from headwise.params import bounded, instant, seconds, window_seconds
from headwise.schema import HORIZON_FUTURE_SEC, HORIZON_PAST_SEC


def arrival_horizon_filter(arrivals, now_epoch=None):
    """Keep arrivals from one hour ago to four hours ahead, both ends included.

    ``now_epoch`` defaults to each row's own poll, so late batches filter alike.
    """
    if now_epoch is None:
        now_epoch = F.unix_seconds("poll_ts")
    return arrivals.where(
        F.col("arrival").between(now_epoch - HORIZON_PAST_SEC, now_epoch + HORIZON_FUTURE_SEC)
    )


def recent_window_filter(scores, window="15m", as_of=None, closed=False, default_minutes=15):
    """Rows observed in the window before ``as_of``; ``closed`` also bounds it above.

    On a table partitioned by ``observed_date`` the same bound prunes partitions.
    """
    upper = instant(as_of, scores)
    lower = upper - seconds(window_seconds(window, default_minutes))
    keep = F.col("observed_ts") >= lower
    if closed:
        keep = keep & (F.col("observed_ts") <= upper)
    if "observed_date" in scores.columns:
        keep = keep & (F.col("observed_date") >= F.to_date(lower))
        if closed:
            keep = keep & (F.col("observed_date") <= F.to_date(upper))
    return scores.where(keep)


def route_filter(scores, route_id="All"):
    if not route_id or route_id.lower() == "all":
        return scores
    return scores.where(F.col("route_id") == route_id)


def min_score_filter(scores, min_score=0.0):
    bounded("min_score", min_score, 0.0, 1.0)
    return scores.where(F.col("anomaly_score") >= min_score) if min_score > 0 else scores


def is_scored():
    return F.col("predicted_headway_sec").isNotNull()


def is_unscored():
    return F.col("headway_sec").isNotNull() & F.col("predicted_headway_sec").isNull()


def scored(scores):
    return scores.where(is_scored())


def unscored(scores):
    return scores.where(is_unscored())


def positive_headway(rows, column="headway_sec"):
    """Numeric and positive; text that is no number is dropped, not an error."""
    number = F.col(column).try_cast("double")
    return rows.withColumn(column, number).where((number > 0) & ~F.isnan(number))
