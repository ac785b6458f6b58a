"""Declared schemas and the constants every module agrees on."""
from pyspark.sql import types as T

_PLAIN = {
    "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def plain_fields(text):
    """Fields of a list like ``"id long, score double"``; unlike ``fromDDL`` it needs no session."""
    return [T.StructField(name, _PLAIN[kind]) for name, kind in (f.split() for f in text.split(","))]

SCORES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("observed_ts", T.TimestampType(), False),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("route_id", T.StringType(), False),
    T.StructField("stop_id", T.StringType(), False),
    T.StructField("headway_sec", T.DoubleType()),
    T.StructField("predicted_headway_sec", T.DoubleType()),
    T.StructField("anomaly_score", T.DoubleType(), False),
    T.StructField("residual", T.DoubleType()),
    T.StructField("window_sec", T.IntegerType()),
])

_TIME = T.StructType([T.StructField("time", T.LongType())])
_TRIP = T.StructType([T.StructField("route_id", T.StringType())])
_STOP_UPDATE = T.StructType([
    T.StructField("stop_id", T.StringType()),
    T.StructField("arrival", _TIME),
    T.StructField("departure", _TIME),
])
_ENTITY = T.StructType([
    T.StructField("trip_update", T.StructType([
        T.StructField("trip", _TRIP),
        T.StructField("stop_time_update", T.ArrayType(_STOP_UPDATE)),
    ])),
    T.StructField("vehicle", T.StructType([
        T.StructField("trip", _TRIP),
        T.StructField("stop_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
    ])),
])
SNAPSHOT = T.StructType([
    T.StructField("feed", T.StringType()),
    T.StructField("poll_ts", T.TimestampType()),
    T.StructField("entity", T.ArrayType(_ENTITY)),
])

STOPS_CSV = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("stop_id", "stop_name", "stop_lat", "stop_lon")
])
ROUTES_CSV = T.StructType([T.StructField("route_id", T.StringType())])

TELEMETRY = T.StructType([
    T.StructField("rows_seen", T.LongType()),
    T.StructField("rows_updated", T.LongType()),
    T.StructField("drift_events", T.LongType()),
    T.StructField("mae_ema", T.DoubleType()),
    T.StructField("residual_q90", T.DoubleType()),
    T.StructField("residual_q99", T.DoubleType()),
    T.StructField("last_batch_processed", T.LongType()),
    T.StructField("unscored_backlog", T.LongType()),
    T.StructField("last_run_utc", T.StringType()),
])

# Feed labels in polling order.
FEEDS = ["ACE", "BDFM", "G", "JZ", "NQRW", "L", "SI", "1234567"]

# Observation and scoring constants of the data model.
DEFAULT_WINDOW_SEC = 300
HORIZON_PAST_SEC = 3600
HORIZON_FUTURE_SEC = 14400
ANOMALY_SCORE = 0.60
HIGH_ANOMALY_SCORE = 0.85
ROUTE_HASH_MOD = 997
STOP_HASH_MOD = 4093
EMA_KEEP = 0.92
EMA_TAKE = 0.08
RESIDUAL_HISTORY = 8000
RESIDUAL_HISTORY_MIN = 64
SCORING_BATCH = 1024
LOCAL_ZONE = "America/New_York"
