"""Feed snapshots: reading landed JSON and flattening the nested entities."""
from pyspark.sql import functions as F, types as T

from headwise.schema import SNAPSHOT

_CORRUPT = "_corrupt_record"


def landing_schema():
    """Snapshot schema of a landing folder; ``feed`` is a directory level there."""
    fields = [f for f in SNAPSHOT.fields if f.name != "feed"]
    return T.StructType(fields + [T.StructField(_CORRUPT, T.StringType()), T.StructField("feed", T.StringType())])


def drop_corrupt(rows):
    return rows.where(F.col(_CORRUPT).isNull()).drop(_CORRUPT)


def feed_union(spark, landing):
    """All feeds below ``landing/feed=<label>/``.

    An absent or empty feed contributes nothing; an unreadable snapshot or file
    is skipped and the other snapshots continue.
    """
    rows = (
        spark.read.schema(landing_schema())
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
        .option("ignoreCorruptFiles", "true")
        .json(landing)
    )
    return drop_corrupt(rows)


def feed_stream(spark, landing, max_files=1000):
    """The same landing folder as a stream of new snapshot files; unreadable ones are skipped here, too."""
    rows = (
        spark.readStream.schema(landing_schema())
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
        .option("maxFilesPerTrigger", max_files).option("ignoreCorruptFiles", "true")
        .json(landing)
    )
    return drop_corrupt(rows)


def land_snapshots(lines, landing):
    """Write snapshot lines (columns ``feed``, ``value``) as text below feed directories."""
    lines.select("feed", "value").write.partitionBy("feed").text(landing)


def snapshot_lines(snapshots):
    return snapshots.select("feed", F.to_json(F.struct("poll_ts", "entity")).alias("value"))


def feed_flatten(snapshots):
    """One row per usable (route, stop, arrival).

    Arrival time wins over departure time, zero counts as missing, and an
    entity without trip update falls back to its vehicle position.
    """
    entities = snapshots.select("feed", "poll_ts", F.explode("entity").alias("e"))
    is_trip = F.col("e.trip_update").isNotNull()
    updates = "array<struct<stop_id:string,arrival:struct<time:bigint>,departure:struct<time:bigint>>>"
    position = F.array(F.struct(
        F.col("e.vehicle.stop_id"), F.struct(F.col("e.vehicle.timestamp")), F.lit(None).cast("struct<time:bigint>")
    )).cast(updates)
    visits = entities.select(
        "feed", "poll_ts",
        F.when(is_trip, F.col("e.trip_update.trip.route_id"))
        .otherwise(F.col("e.vehicle.trip.route_id")).alias("route_id"),
        F.inline(F.when(is_trip, F.col("e.trip_update.stop_time_update").cast(updates)).otherwise(position)),
    )
    given = lambda time: F.nullif(F.col(time), F.lit(0))
    observed = visits.select(
        "feed", "poll_ts", "route_id", "stop_id",
        F.coalesce(given("arrival.time"), given("departure.time")).alias("arrival"),
    )
    return observed.where(
        (F.col("route_id") != "") & (F.col("stop_id") != "") & F.col("arrival").isNotNull()
    )
