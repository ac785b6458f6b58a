"""Parsing and validation of query parameters."""
from datetime import datetime, timezone

from pyspark.sql import Column, functions as F


def window_seconds(window, default_minutes=15):
    """'30m' and '2h' style windows; any other suffix means the default."""
    text = window.strip().lower()
    units = {"m": 60, "h": 3600}
    if text and text[-1] in units:
        return int(text[:-1]) * units[text[-1]]
    return default_minutes * 60


def parse_instant(text):
    """ISO instant to an aware UTC datetime; 'now' or empty means no fixed instant."""
    if not text or text.strip().lower() == "now":
        return None
    value = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def bounded(name, value, low, high):
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in [{low}, {high}], got {value}")
    return value


def newest(scores):
    """Newest observation time as a scalar subquery.

    On a table partitioned by ``observed_date`` only the newest date is read.
    """
    if "observed_date" in scores.columns:
        last_date = scores.agg(F.max("observed_date")).scalar()
        scores = scores.where(F.col("observed_date") == last_date)
    return scores.agg(F.max("observed_ts")).scalar()


def instant(as_of, scores):
    """Column for the reference instant.

    ``None`` means the newest observation: Spark runs that subquery first and
    still pushes the resulting bound into the scan.
    """
    if as_of is None:
        return newest(scores)
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = parse_instant(as_of)
        return F.current_timestamp() if as_of is None else F.lit(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    return F.lit(as_of)


def seconds(n):
    return F.expr(f"INTERVAL '{int(n)}' SECOND")
