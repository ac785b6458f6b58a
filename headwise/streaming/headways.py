"""Incremental headways with the last arrival of each key as durable, expiring state."""
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from headwise.operators.filters import arrival_horizon_filter
from headwise.operators.windows import feed_order

_HELD_ROWS = 200_000
_KEY = ["route_id", "stop_id"]
_POLL_KEY = ["poll_ts", "feed", "feed_ord", *_KEY]
_COMBINED = "poll_ts timestamp, feed string, feed_ord long, route_id string, stop_id string, arrival long"
_OUT = f"{_COMBINED}, prev_arrival long, headway_sec double"
#: How long a key that gets no rows is remembered.
IDLE_MS = 30 * 24 * 3600 * 1000


class LastArrivals(StatefulProcessor):
    """Earliest arrival per poll, then the step from the remembered arrival.

    The state of a bucket is a map from (route, stop) to the last arrival and the poll that it came with. Only
    the keys of a micro-batch are read and written, and an entry that is not written again within ``idle_ms``
    expires. A poll that comes after a later one (or once more) moves nothing back: its rows pass without a
    previous arrival. A snapshot file is read in one micro-batch, so a poll of a feed is complete when it
    gets here.
    """

    def __init__(self, idle_ms):
        self.idle_ms = idle_ms

    def init(self, handle):
        self.last = handle.getMapState(
            "last_arrivals", "route_id string, stop_id string",
            "poll_us long, feed_ord long, feed string, arrival long", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        earliest = pd.concat(list(rows)).groupby(_POLL_KEY, as_index=False, dropna=False)["arrival"].min()
        # The same order within a micro-batch and across them; a null feed comes first.
        place = pd.DataFrame({
            "poll_us": earliest["poll_ts"].astype("datetime64[us]").astype("int64"),
            "place_ord": earliest["feed_ord"].fillna(-1).astype("int64"),
            "place_feed": earliest["feed"].fillna(""),
        })
        earliest = pd.concat([earliest, place], axis=1).sort_values(
            [*_KEY, *place.columns], ignore_index=True)
        keys = list(earliest[_KEY].drop_duplicates().itertuples(index=False, name=None))
        known = dict(zip(keys, map(self.last.getValue, keys)))
        places = list(zip(*(earliest[c] for c in place.columns)))
        of_key = list(zip(*(earliest[c] for c in _KEY)))
        late = pd.Series([
            known[k] is not None and p <= tuple(known[k])[:3] for k, p in zip(of_key, places)
        ], index=earliest.index, dtype=bool)
        current = earliest[~late]
        carried = pd.Series([known[k][3] if known[k] is not None else None for k in of_key], dtype="Int64")
        previous = current.groupby(_KEY)["arrival"].shift().astype("Int64").fillna(carried[~late])
        previous = previous.reindex(earliest.index)
        for entry in current.drop_duplicates(_KEY, keep="last").itertuples(index=False):
            self.last.updateValue(
                (entry.route_id, entry.stop_id), (entry.poll_us, entry.place_ord, entry.place_feed, entry.arrival))
        step = earliest["arrival"].astype("Int64") - previous
        headway = step.where(step > 0).astype("Float64")
        yield earliest.drop(columns=place.columns).assign(prev_arrival=previous, headway_sec=headway)

    def close(self):
        pass


def _combine(frames):
    """Earliest arrival per poll and key among the rows of a partition.

    Partial results are held up to a bound, then passed on, so memory stays
    bounded and nothing is lost: the keyed state takes the minimum again.
    """
    held, size = [], 0
    fold = lambda: pd.concat(held).groupby(_POLL_KEY, as_index=False, sort=False, dropna=False)["arrival"].min()
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size > _HELD_ROWS:
            held = [fold()]
            size = len(held[0])
            if size > _HELD_ROWS // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield fold()


def stream_headway(arrivals, buckets=256, idle_ms=IDLE_MS):
    """Streaming (poll_ts, feed, route_id, stop_id, arrival) rows to headways.

    Rows are combined before the shuffle, as a batch aggregate would do: a busy
    key sends about one row per poll to its state, not all of its arrivals.
    ``buckets`` is fixed for the life of a stream and bounds how many tasks share
    the keys; state is kept per key. A key is forgotten ``idle_ms`` after its last row.
    """
    ordered = arrival_horizon_filter(arrivals).withColumn("feed_ord", feed_order(F.col("feed")))
    combined = ordered.select(*_POLL_KEY, "arrival").mapInPandas(_combine, _COMBINED)
    bucketed = combined.withColumn("bucket", F.pmod(F.xxhash64(*_KEY), F.lit(buckets)))
    return bucketed.groupBy("bucket").transformWithStateInPandas(
        LastArrivals(idle_ms), outputStructType=_OUT, outputMode="Append", timeMode="ProcessingTime"
    )
