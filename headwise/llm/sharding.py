"""Histogram sort into shards of nearly equal bytes (native functions only).

Rows are ordered by a pair of digests, first of the text, then of the row, so equal texts stand together.
The splitters between shards are found by counting: each round sums the exact bytes below a set of probes,
keeps for every splitter the bin that holds its target, and probes that bin again. Then every row is
exchanged once, to its place.
"""
import math
from dataclasses import dataclass

from pyspark.sql import functions as F

from headwise.llm.common import fields, power_of_two, rank_in_parts, write_and_read

KEY_BITS = 62
PROBES = 1024
SHARDS = 16
#: A splitter may miss its target by this share of a shard, if that keeps a group of equal texts whole.
TOLERANCE = 0.002
#: Rows that are numbered together, on average.
BIN_ROWS = 4096


@dataclass
class _Search:
    """The bin in which one splitter is sought: the rows of ``group`` (all if None) with low <= key <= high."""
    target: float
    group: int | None
    low: int
    high: int
    below: int


def digest(*columns):
    """A non-negative digest of ``KEY_BITS`` bits; nulls have one too."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - KEY_BITS)


def _histogram(rows, searches):
    """Exact bytes, least and largest key of every probe bin of the open searches; bounded rows."""
    probes = max(8, PROBES // max(1, len(searches)))
    spot = F.lit(None).cast("struct<search:int,bin:bigint,key:bigint>")
    for i, s in enumerate(searches):
        key = F.col("_h") if s.group is None else F.col("_d")
        inside = key.between(s.low, s.high)
        if s.group is not None:
            inside = inside & (F.col("_h") == s.group)
        width = (s.high - s.low) // probes + 1
        column = "_h" if s.group is None else "_d"
        here = F.struct(
            F.lit(i).alias("search"), F.expr(f"({column} - {s.low}L) div {width}L").alias("bin"), key.alias("key"))
        spot = F.when(inside, here).otherwise(spot)
    counted = rows.select(spot.alias("spot"), "size").filter("spot is not null").groupBy("spot.search", "spot.bin").agg(
        F.sum("size").alias("bytes"), F.min("spot.key").alias("least"), F.max("spot.key").alias("most"))
    found = [[] for _ in searches]
    for row in sorted(counted.collect(), key=lambda r: (r["search"], r["bin"])):
        found[row["search"]].append(row)
    return found


def find_splitters(rows, shards, tolerance=TOLERANCE):
    """Shard boundaries as (digest, row digest) pairs: a row belongs above each boundary it is not below.

    A boundary (h, None) lies before the whole group of texts with digest h; (h, d) lies inside the group.
    The driver holds at most ``PROBES`` sums a round; the rounds end as each narrows a bin by its probes.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    top = (1 << KEY_BITS) - 1
    open_searches = {k: _Search(total * k / shards, None, 0, top, 0) for k in range(1, shards)} if total else {}
    done = {}
    while open_searches:
        # Splitters in one bin share a search of it.
        bins = {}
        for k, s in open_searches.items():
            bins.setdefault((s.group, s.low, s.high, s.below), []).append(k)
        places = list(bins)
        found = _histogram(rows, [_Search(0, *place) for place in places])
        following = {}
        for place, histogram in zip(places, found):
            for k in bins[place]:
                group, _, _, below = place
                target = open_searches[k].target
                for j, row in enumerate(histogram):
                    if below + row["bytes"] >= target or j == len(histogram) - 1:
                        break
                    below += row["bytes"]
                after = below + row["bytes"]
                near_low = target - below <= after - target
                single = row["least"] == row["most"]
                if min(target - below, after - target) <= slack or (single and group is not None):
                    edge = row["least"] if near_low else row["most"] + 1
                    done[k] = (edge, None) if group is None else (group, edge)
                elif single:
                    following[k] = _Search(target, row["least"], 0, top, below)
                else:
                    following[k] = _Search(target, group, row["least"], row["most"], below)
        open_searches = following
    return [done[k] for k in sorted(done)]


def _shard(splitters):
    """Shard number: how many boundaries a row is not below."""
    place = F.lit(0)
    for number, (h, d) in enumerate(splitters, 1):
        above = F.col("_h") >= h if d is None else (F.col("_h") > h) | ((F.col("_h") == h) & (F.col("_d") >= d))
        place = F.when(above, number).otherwise(place)
    return place


def number_slots(placed, bin_rows):
    """Add ``slot``: the gapless place of a row within its shard, in key order.

    No shard is sorted in one task. Rows are counted in bins of equal key range, bins that hold a large
    group of equal texts are cut again by text and row digest, and a row's slot is the count of all earlier bins
    plus its place in its own.
    """
    rows = placed.count()
    depth = int(math.log2(power_of_two(max(1, rows // bin_rows))))
    binned = placed.withColumn("_bin", F.shiftright("_h", KEY_BITS - depth) if depth else F.lit(0).cast("long"))
    full = binned.groupBy("shard", "_bin").agg(F.count(F.lit(1)).alias("_rows"))
    # Twice the mean is chance; beyond it a group stands out and is cut into parts.
    parts = F.when(F.col("_rows") > 2 * bin_rows, F.ceil(F.col("_rows") / bin_rows)).otherwise(1)
    hot = write_and_read(full.select("shard", "_bin", parts.cast("long").alias("_parts")).filter("_parts > 1"), "hotbins")
    cut = binned.join(hot, ["shard", "_bin"], "left").withColumns({
        "_text": F.when(F.col("_parts").isNull(), 0).otherwise(F.col("_h")),
        "_part": F.coalesce(F.expr(f"_d div ({1 << KEY_BITS}L div _parts + 1)"), F.lit(0).cast("long")),
    }).drop("_parts")
    return rank_in_parts(cut, ["shard"], ["_bin", "_text", "_part"], ["_h", "_d"], "slot").drop("_bin", "_text", "_part")


def shard_rows(df, shards=SHARDS, tolerance=TOLERANCE, bin_rows=BIN_ROWS):
    """Sort rows into ``shards`` shards of nearly equal bytes.

    ``df`` needs text digests ``_h``, row digests ``_d`` (see :func:`digest`) and ``size``, and is read
    several times, so it should be a written table. Its other columns stay, with shard and slot added.
    Groups of equal texts stand together and are only cut where a shard would miss its share by more than
    the tolerance. An empty table gives no rows; fewer rows than shards leave shards empty.
    """
    splitters = find_splitters(df, shards, tolerance)
    return number_slots(df.withColumn("shard", _shard(splitters)), bin_rows)


def sharded_documents(docs, shards=SHARDS):
    """doc_id, size, text_crc32, shard and slot of every document, repeated rows included."""
    text = F.coalesce("text", F.lit(""))
    slim = fields(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        digest("text").alias("_h"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # The row number is part of the written table, so a repeated task cannot change it any more.
    written = write_and_read(slim, "shard-keys").withColumn("_d", digest("doc_id", "_row"))
    return shard_rows(written, shards).drop("_h", "_d", "_row")
