"""Exact per-key row numbers, bounded chunks of an ordered key, and steps in strict order."""
import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F, types as T

from headwise.schema import plain_fields


def number_rows(df, keys, order, slices):
    """Add ``seq``: 0-based within ``keys`` by ``order``.

    A window over the key would put a hot key into one task. Here ``slices``, columns that never decrease with
    ``order`` (an hour, a poll), cut each key: rows are numbered within their slice, and a row's number is the
    count of the earlier slices plus its place in its own. ``order`` must be unique within a key.
    """
    place = [*keys, *slices]
    before = Window.partitionBy(*keys).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).select(
        *place, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy(*place).orderBy(*order)) - 1
    return df.withColumn("_own", own).join(offsets, place).withColumn(
        "seq", F.col("_own") + F.col("_offset")).drop("_own", "_offset")


def replay_chunks(numbered, seq, chunk_rows, warmup_rows):
    """Split each key, numbered by ``seq``, into chunks of ``chunk_rows`` and give every chunk a run-up.

    A row belongs to one chunk (``live``); the last ``warmup_rows`` of a chunk
    are repeated in front of the next one, so that a windowed function sees what
    it needs. Groups hold at most chunk_rows + warmup_rows rows.
    """
    if not 0 <= warmup_rows <= chunk_rows:
        raise ValueError("warmup_rows must not exceed chunk_rows")
    own = F.floor(F.col(seq) / F.lit(chunk_rows)).cast("long")
    live = F.struct(own.alias("chunk"), F.lit(True).alias("live"))
    run_up = F.struct((own + 1).alias("chunk"), F.lit(False).alias("live"))
    repeats = F.col(seq) % chunk_rows >= chunk_rows - warmup_rows
    return numbered.select("*", F.inline(F.when(repeats, F.array(live, run_up)).otherwise(F.array(live))))


def in_order(rows, inputs, make, outputs, states=None, carry=()):
    """Run a step over the rows of each route in order of (observed_ts, id).

    For recurrences that have no other form. ``make(text)`` gives a step object, new or from its saved ``state``;
    its ``advance`` takes the ``inputs`` arrays of consecutive rows and returns ``outputs``. A task holds one
    batch of rows and the state of one route, whatever the length of the route; routes run in parallel.
    Returns the rows with id, route_id, observed_ts, ``carry`` and ``outputs`` and, for every route, one more row
    with only its final ``state``.
    """
    head = ["route_id", "id", "observed_ts", *carry]
    rows = rows.select(*dict.fromkeys([*head, *inputs]), F.lit(None).cast("string").alias("state"))
    schema = T.StructType([
        *[T.StructField(c, rows.schema[c].dataType) for c in head], *plain_fields(outputs),
        T.StructField("state", T.StringType())])
    names = schema.fieldNames()
    if states is not None:
        rows = rows.unionByName(states.select("route_id", "state"), allowMissingColumns=True)
    ordered = rows.repartition("route_id").sortWithinPartitions(
        "route_id", F.col("state").isNull(), "observed_ts", "id")

    def final(route, step):
        row = {**dict.fromkeys(names), "route_id": route, "state": step.to_json()}
        return pd.DataFrame([row], columns=names, dtype=object)

    def run(frames):
        route, step = None, None
        for frame in frames:
            if frame.empty:
                continue
            keys = frame["route_id"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(frame)]
            done = []
            for start, stop in zip(cuts, cuts[1:]):
                piece = frame.iloc[start:stop]
                if step is None or keys[start] != route:
                    if step is not None:
                        yield final(route, step)
                    saved = piece["state"].iloc[0]
                    route, step = keys[start], make(saved if isinstance(saved, str) else None)
                piece = piece[piece["state"].isna()]
                if len(piece):
                    found = step.advance(*[piece[c].to_numpy() for c in inputs])
                    done.append(piece[names[: len(head)]].assign(**found, state=None)[names])
            if done:
                yield pd.concat(done)
        if step is not None:
            yield final(route, step)

    return ordered.mapInPandas(run, schema)
