"""Lookups. There are no broadcast hints anywhere: Spark broadcasts a side whose
size is below its threshold and otherwise sort-merges, splitting skewed partitions."""
from pyspark.sql import functions as F


def features_join_stats(rows, stats):
    return rows.join(stats, ["route_id", "stop_id", "hour"], "left")


def stop_name_left_join(rows, stops):
    return rows.join(stops.select("stop_id", "stop_name"), "stop_id", "left")


def stop_geo_inner_join(rows, stops):
    return rows.join(stops.select("stop_id", "stop_name", "lat", "lon"), "stop_id", "inner")


def last_seen_lookup(arrivals, last_seen):
    """Previous arrival of each key as recorded in the keyed state table."""
    state = last_seen.select("route_id", "stop_id", F.col("arrival").alias("prev_arrival"))
    return arrivals.join(state, ["route_id", "stop_id"], "left")
