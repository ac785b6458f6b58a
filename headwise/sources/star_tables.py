"""Maps the star-schema test tables onto the engine's own tables.

The same mapping is written in SQL in ``plans.oracles``.
"""
from pyspark.sql import functions as F

from headwise.schema import FEEDS

_POLL_SEC = 3600

# Declared, not inferred. Reading ``ts`` as an instant (the session clock is
# UTC) needs no cast, so time bounds reach the Parquet scan.
_SCHEMAS = {
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}


def table(spark, folder, name):
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def events_stream(spark, folder):
    """The events table as a file stream. The pattern matches a folder or a single
    file, which a stream would not take as a plain path."""
    return spark.readStream.schema(_SCHEMAS["events"]).parquet(f"{folder}/event[s].parquet")


def raw_scores(spark, folder, events=None):
    """Events as unscored headway observations."""
    events = table(spark, folder, "events") if events is None else events
    ts = F.col("ts")
    later = ts + F.expr("INTERVAL '60' SECOND")
    return events.select(
        F.col("event_id").alias("id"),
        ts.alias("observed_ts"),
        F.when(F.col("event_id") % 11 != 0, later).alias("event_ts"),
        F.col("event_type").alias("route_id"),
        F.col("user_id").cast("string").alias("stop_id"),
        (F.col("value") * 10).alias("headway_sec"),
        F.lit(None).cast("double").alias("predicted_headway_sec"),
        F.lit(0.0).alias("anomaly_score"),
        F.lit(None).cast("double").alias("residual"),
        F.lit(300).alias("window_sec"),
    )


def served_scores(spark, folder, events=None):
    """Events as a scored table: the route mean predicts, every seventh row is unscored."""
    raw = raw_scores(spark, folder, events)
    means = raw_scores(spark, folder).groupBy("route_id").agg(F.round(F.avg("headway_sec"), 6).alias("_mean"))
    predicted = F.when(F.col("id") % 7 != 0, F.col("_mean"))
    return (
        raw.join(means, "route_id", "left")
        .withColumn("predicted_headway_sec", predicted)
        .withColumn("residual", F.col("headway_sec") - F.col("predicted_headway_sec"))
        .withColumn(
            "anomaly_score",
            F.when(F.col("residual").isNull(), F.lit(0.0))
            .otherwise(F.least(F.lit(1.0), F.abs("residual") / 1000)),
        )
        .select(*raw.columns)
    )


def errors(spark, folder):
    """Scored rows with a squared-residual error, standing for a reconstruction error."""
    scored = served_scores(spark, folder).where(F.col("predicted_headway_sec").isNotNull())
    share = F.col("residual") / 100.0
    return scored.withColumn("err", share * share).withColumnRenamed("anomaly_score", "online_score")


def stops(spark, folder):
    """Customers as stops; every tenth is missing from the dimension."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").where(key % 10 != 0).select(
        key.cast("string").alias("stop_id"),
        F.col("c_name").alias("stop_name"),
        (40.0 + (key % 100) / 100).alias("lat"),
        (-74.0 + (key % 37) / 100).alias("lon"),
        F.array().cast("array<string>").alias("routes"),
    )


def static_routes(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_mktsegment").alias("route_id")).distinct()


def stops_csv_rows(spark, folder):
    """Stop file lines with more columns than needed: ids need trimming, names hold quotes, and every fifth
    stop comes first with an unreadable latitude and then again with a good one."""
    key = F.col("c_custkey")
    sid = F.concat(F.lit(" "), key.cast("string"), F.lit(" "))
    lat = (40.0 + (key % 100) / 100).cast("string")
    lon = (-74.0 + (key % 37) / 100).cast("string")
    line = lambda latitude: F.struct(
        F.lit("0").alias("location_type"), lon.alias("stop_lon"), sid.alias("stop_id"),
        F.concat(F.lit('The "'), F.col("c_name"), F.lit('", stop')).alias("stop_name"),
        latitude.alias("stop_lat"), F.lit("").alias("parent_station"),
    )
    lines = F.when(key % 5 == 0, F.array(line(F.lit("n/a")), line(lat))).otherwise(
        F.array(line(lat), line(F.lit("0.0")))
    )
    return table(spark, folder, "customer").select(F.inline(lines))


def routes_csv_rows(spark, folder):
    """Route file lines with padding and blanks."""
    return table(spark, folder, "customer").select(
        F.when(F.col("c_custkey") % 7 == 0, F.lit("  "))
        .otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("route_id"),
        F.lit("x").alias("agency_id"),
    )


def snapshots(spark, folder, events=None):
    """Events as nested feed snapshots, one poll per hour.

    A fifth of the entities are vehicle positions; the others carry two stop
    updates whose times are given, zero or missing. Some lie beyond the horizon.
    """
    events = table(spark, folder, "events") if events is None else events
    eid = F.col("event_id")
    ts = F.col("ts")
    poll = F.date_trunc("hour", ts) + F.expr(f"INTERVAL '{_POLL_SEC}' SECOND")
    epoch = F.unix_seconds(ts) + F.when(eid % 13 == 0, F.lit(5 * 3600)).otherwise(F.lit(0))
    kind = eid % 5
    none = F.lit(None).cast("long")
    time = lambda value: F.struct(value.cast("long").alias("time"))
    no_time = F.lit(None).cast("struct<time:bigint>")
    trip = F.struct(F.when(eid % 17 == 0, F.lit("")).otherwise(F.col("event_type")).alias("route_id"))
    arrival = (
        F.when(kind == 1, time(F.lit(0))).when(kind == 2, time(epoch)).otherwise(no_time)
    )
    departure = F.when(kind == 4, no_time).otherwise(time(epoch + 30))
    update = lambda stop, arr, dep: F.struct(
        stop.cast("string").alias("stop_id"), arr.alias("arrival"), dep.alias("departure")
    )
    trip_update = F.when(
        kind != 0,
        F.struct(
            trip.alias("trip"),
            F.array(
                update(F.col("user_id"), arrival, departure),
                update(F.col("user_id") + 1, time(epoch + 120), no_time),
            ).alias("stop_time_update"),
        ),
    )
    vehicle = F.when(
        kind == 0,
        F.struct(
            trip.alias("trip"), F.col("user_id").cast("string").alias("stop_id"),
            F.when(eid % 3 != 0, epoch).otherwise(none).alias("timestamp"),
        ),
    )
    return events.select(
        F.element_at(F.array(*[F.lit(f) for f in FEEDS]), (eid % len(FEEDS) + 1).cast("int")).alias("feed"),
        poll.alias("poll_ts"),
        F.array(F.struct(trip_update.alias("trip_update"), vehicle.alias("vehicle"))).alias("entity"),
    )


def land_in_slices(rows, path, slices, files=2):
    """Write rows as files of consecutive time slices, one slice after the other; returns (path, files per slice)."""
    bounds = rows.agg(F.min("observed_ts").alias("a"), F.max("observed_ts").alias("b")).first()
    step = (bounds["b"] - bounds["a"]) / slices if bounds["a"] else None
    for k in range(slices if step is not None else 0):
        part = rows.where(F.col("observed_ts") >= F.lit(bounds["a"] + k * step))
        if k < slices - 1:
            part = part.where(F.col("observed_ts") < F.lit(bounds["a"] + (k + 1) * step))
        part.repartition(files).write.mode("append").parquet(path)
    return path, files
