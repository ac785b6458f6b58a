"""GeoJSON text built by native struct and JSON functions."""
from pyspark.sql import functions as F

from headwise.session import write_and_read

#: Depth of the quadtree (cells of about 600 m), and how many features a tile holds at most.
TILE_LEVELS, TILE_FEATURES = 16, 1000

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _point(lon, lat):
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def _feature(geometry, properties):
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            geometry.alias("geometry"),
            F.struct(*properties).alias("properties"),
        ),
        _KEEP_NULLS,
    )


def event_feature(df):
    """One anomaly Feature; the event time keys exist only where there is an event time."""
    always = [
        F.col("stop_id"), F.col("stop_name"), F.col("route_id"),
        F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"),
        F.coalesce("residual", F.lit(0.0)).alias("residual"),
        F.col("headway_sec"), F.col("predicted_headway_sec"),
        F.col("observed_ts_utc"), F.col("observed_ts_epoch_ms"), F.col("observed_ts_ny"),
    ]
    event = [F.col("event_ts_utc"), F.col("event_ts_epoch_ms"), F.col("event_ts_ny")]
    point = _point(F.col("lon"), F.col("lat"))
    return df.withColumn(
        "feature",
        F.when(F.col("event_ts").isNull(), _feature(point, always))
        .otherwise(_feature(point, always + event)),
    )


def station_feature(stops):
    """The station layer: one Feature per stop of the dimension."""
    point = _point(F.col("lon"), F.col("lat"))
    return stops.withColumn("feature", _feature(point, [F.col("stop_id"), F.col("stop_name")]))


def _tile_code(lon, lat, levels):
    """Quadtree cell of a position as one number, two bits per level; positions outside the map go to its edge."""
    side = 1 << levels
    place = lambda degrees, span: F.coalesce(F.least(F.greatest(F.floor(
        (F.coalesce(degrees, F.lit(0.0)) + span / 2) / span * side), F.lit(0)), F.lit(side - 1)), F.lit(0)).cast("long")
    x, y = place(lon, 360.0), place(lat, 180.0)
    code = F.lit(0).cast("long")
    for level in range(levels):
        bit = lambda v: F.shiftright(v, level).bitwiseAND(F.lit(1).cast("long"))
        code = code + bit(x) * (1 << (2 * level)) + bit(y) * (1 << (2 * level + 1))
    return code


def feature_tiles(features, levels=TILE_LEVELS, limit=TILE_FEATURES):
    """``features`` (lon, lat, feature) with the tile and part that each belongs to.

    A tile is the largest cell of a quadtree, named by its level and code, that holds at most ``limit`` features.
    Counts of the finest cells are added up level by level; rows are not moved for it. A finest cell that is still
    too full is dealt into parts of about half the limit by a hash of the feature, so no part holds a whole hot cell.
    Missing coordinates count as 0; equal features stay separate rows of one part.
    """
    coded = features.withColumn("_cell", _tile_code(F.col("lon"), F.col("lat"), levels))
    cells = write_and_read(coded.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")), "cells")
    level = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    prefix = lambda cell: F.expr(f"shiftright({cell}, 2 * ({levels} - _level))")
    counts = cells.select("*", level.alias("_level")).groupBy("_level", prefix("_cell").alias("_prefix")).agg(F.sum("_n").alias("_held"))
    chosen = cells.select("*", level.alias("_level")).withColumn("_prefix", prefix("_cell")).join(counts, ["_level", "_prefix"]).where(
        (F.col("_held") <= limit) | (F.col("_level") == levels)).groupBy("_cell").agg(
        F.min(F.struct("_level", "_prefix", "_held")).alias("_tile"))
    parts = F.when(F.col("_tile._held") <= limit, F.lit(1)).otherwise(F.ceil(2 * F.col("_tile._held") / limit))
    return coded.join(chosen, "_cell").select(
        *features.columns, F.col("_tile._level").alias("tile_level"), F.col("_tile._prefix").alias("tile"),
        F.pmod(F.xxhash64("feature"), parts.cast("long")).alias("part"))


def feature_collections(features, timestamp, levels=TILE_LEVELS, limit=TILE_FEATURES):
    """GeoJSON documents for a map client, one per tile part; together they hold every feature once."""
    return feature_tiles(features, levels, limit).groupBy("tile_level", "tile", "part").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.concat(
            F.lit('{"type":"FeatureCollection","timestamp":"'), timestamp,
            F.lit('","features":['), F.array_join(F.array_sort(F.collect_list("feature")), ","), F.lit("]}"),
        ).alias("collection"))
