"""Time expressions. The session time zone is UTC (see ``session.prepare``)."""
import math

from pyspark.sql import functions as F

from headwise.schema import LOCAL_ZONE


def utc_text(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_text(ts, zone=LOCAL_ZONE):
    """Wall-clock text of ``zone`` with its UTC offset, DST included."""
    local = F.from_utc_timestamp(ts, zone)
    minutes = ((F.unix_seconds(local) - F.unix_seconds(ts)) / 60).cast("int")
    offset = F.format_string(
        "%s%02d:%02d",
        F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
        F.floor(F.abs(minutes) / 60).cast("int"),
        F.abs(minutes) % 60,
    )
    text = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)
    return F.when(ts.isNotNull(), text)


def ts_pack(ts, prefix=""):
    """Three columns for one instant: UTC text, epoch milliseconds, local text."""
    stem = f"{prefix}_ts_" if prefix else ""
    return [
        utc_text(ts).alias(f"{stem}utc"),
        F.unix_millis(ts).alias(f"{stem}epoch_ms"),
        local_text(ts).alias(f"{stem}ny"),
    ]


def hour_utc(ts):
    return F.hour(ts)


def minute_utc(ts):
    return F.minute(ts)


def cyclic_time(ts):
    """Hour and minute as points on the unit circle."""
    hour = F.hour(ts) * F.lit(2.0 * math.pi / 24.0)
    minute = F.minute(ts) * F.lit(2.0 * math.pi / 60.0)
    return [
        F.sin(hour).alias("hour_sin"),
        F.cos(hour).alias("hour_cos"),
        F.sin(minute).alias("minute_sin"),
        F.cos(minute).alias("minute_cos"),
    ]


def naive(df):
    """Result timestamps as zone-less UTC wall clock, for external comparison."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name)
        if f.dataType.typeName() == "timestamp" else F.col(f.name)
        for f in df.schema.fields
    ])
