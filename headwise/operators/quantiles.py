"""Exact interpolated quantiles that survive a group holding most of the rows."""
from pyspark.sql import Window, functions as F

from headwise.session import write_and_read

_FINE_PER_OCTAVE = 1 << 21
_COARSE_SHIFT = 16
_CODE_OFFSET = 1100 * _FINE_PER_OCTAVE
# Beyond the code of any finite number.
_INFINITE_CODE = 4 * _CODE_OFFSET
_FOUND = ("n", "_n", "_before", "_least", "_most", "_places")


def exact_quantiles(rows, keys, value, probs):
    """Per group: ``n`` and the array ``quantiles`` (linear interpolation), by one plan whatever the sizes.

    Order statistics are located by counts: of coarse logarithmic bins, then of fine ones inside the coarse bins
    that hold a wanted place, then of the values of those fine bins. A bin knows its least and greatest value, so
    what is wanted at its ends is settled at once, and the rows of small groups are counted once. Every step is a
    counting aggregate with map-side combine, so no task sees a whole group. What a step finds (a row per wanted bin)
    is written, so no step counts again what an earlier one has counted. Nulls and NaN are left out; infinities are
    ordinary ends of the order, and a quantile strictly between the two infinities is NaN.
    """
    rows, keys = _valued(rows, keys, value), list(keys)
    rows = rows.withColumn("_code", _order_code(F.col("_x"))).withColumn("_coarse", F.shiftright("_code", _COARSE_SHIFT))
    rows = rows.withColumn("_all", F.lit(0))
    groups, wanted, settled = ["_all", *keys], None, None
    for bin_column in ("_coarse", "_code", "_x"):
        counted = rows if wanted is None else _joined(rows, wanted, groups)
        payload = [] if wanted is None else [F.first("_places").alias("_places"), F.first("n").alias("n")]
        bins = counted.groupBy(*groups, bin_column).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"), *payload)
        whole = Window.partitionBy(*groups)
        if wanted is None:
            bins = bins.withColumn("n", F.sum("_n").over(whole)).withColumn("_places", _places(probs))
        end = F.sum("_n").over(whole.orderBy(bin_column))
        bins = bins.withColumn("_before", end - F.col("_n"))
        inside = F.filter("_places", lambda p: (p["rank"] >= F.col("_before")) & (p["rank"] < F.col("_before") + F.col("_n")))
        found = write_and_read(
            bins.withColumn("_places", inside).filter(F.size("_places") > 0)
            .select(*groups, bin_column, *_FOUND), "found-bins")
        # The ends of a bin are known: what is wanted there, or from a bin with one value, is settled.
        own = lambda p: p["rank"] - F.col("_before")
        at_end = lambda p: (own(p) == 0) | (own(p) == F.col("_n") - 1) | (F.col("_least") == F.col("_most"))
        done = found.select("_all", *keys, "n", F.inline(F.transform(F.filter("_places", at_end), lambda p: F.struct(
            p["i"].alias("i"), p["side"].alias("side"), p["part"].alias("part"),
            F.when(own(p) == 0, F.col("_least")).otherwise(F.col("_most")).alias("_value")))))
        settled = done if settled is None else settled.unionByName(done)
        groups = [*groups, bin_column]
        # Ranks go on from the start of the bin.
        wanted = found.select(*groups, "n", F.transform(F.filter("_places", lambda p: ~at_end(p)), lambda p: F.struct(
            p["i"].alias("i"), p["side"].alias("side"), own(p).alias("rank"), p["part"].alias("part"))).alias("_places"),
        ).filter(F.size("_places") > 0)
        if wanted.isEmpty():
            break
    side = lambda i, name: F.max(F.when((F.col("i") == i) & (F.col("side") == name), F.col("_value")))
    part = lambda i: F.max(F.when(F.col("i") == i, F.col("part")))
    return settled.groupBy("_all", *keys, "n").agg(F.array(*[
        _between(side(i, "low"), side(i, "high"), part(i)) for i in range(len(probs))]).alias("quantiles")).drop("_all")


def exact_median_mad(rows, keys, value):
    """Per group: median, and median absolute deviation from it; the latter is null where the median is infinite and no row differs."""
    keys = list(keys)
    medians = write_and_read(
        exact_quantiles(rows, keys, value, [0.5]).select(*keys, F.col("quantiles")[0].alias("median")), "medians")
    gaps = _joined(_valued(rows, keys, value), medians, keys).select(*keys, F.abs(F.col("_x") - F.col("median")).alias("_gap"))
    mads = exact_quantiles(gaps, keys, "_gap", [0.5]).select(*keys, F.col("quantiles")[0].alias("mad"))
    return _joined(medians, mads, keys, "left")


def _joined(left, right, keys, how="inner"):
    """A join on ``keys`` in which null keys are equal; the columns of ``left`` and what else ``right`` has."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(right[f"_right_{k}"])
    return left.join(right, same, how).drop(*[f"_right_{k}" for k in keys])


def _valued(rows, keys, value):
    x = F.col(value).cast("double")
    # Neither null nor NaN has a place in an order.
    return rows.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))


def _order_code(x):
    """Integer that grows with x: signed logarithm at 2^-21 octave resolution."""
    finite = F.when(F.abs(x) < float("inf"), F.abs(x))
    magnitude = F.coalesce(F.floor(F.log2(finite) * _FINE_PER_OCTAVE) + F.lit(_CODE_OFFSET), F.lit(_INFINITE_CODE))
    return F.when(x > 0, magnitude).when(x < 0, -magnitude).otherwise(F.lit(0)).cast("long")


def _places(probs):
    """The ranks below and above every wanted place among ``n`` rows."""
    places = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("n") - 1)
        low = F.floor(place).cast("long")
        for side, rank in (("low", low), ("high", F.least(low + 1, F.col("n") - 1))):
            places.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank.alias("rank"), (place - low).alias("part")))
    return F.array(*places)


def _between(low, high, part):
    return F.when((part == 0) | (low == high), low).otherwise(low * (1 - part) + high * part)
