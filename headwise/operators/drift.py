"""Change detection over time buckets."""
from pyspark.sql import Window, functions as F

DELTA = 0.002
RESIDUAL_SCALE = 3600.0


def scaled_residual(residual):
    """Absolute residual mapped to [0, 1], as the detection bound assumes."""
    return F.least(F.abs(residual) / F.lit(RESIDUAL_SCALE), F.lit(1.0))


def drift_cut_scan(rows, key="route_id", bucket="1 day", delta=DELTA):
    """Test every bucket boundary of a key as a cut.

    Rows fold to one partial sum per bucket on the map side. The windows then
    run over buckets only, so their size is the number of buckets.
    """
    x = scaled_residual(F.col("residual"))
    buckets = rows.groupBy(key, F.window("observed_ts", bucket)["start"].alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss")
    )
    upto = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    sums = buckets.select(
        key, "bucket",
        F.sum("n").over(upto).alias("n0"), F.sum("s").over(upto).alias("s0"),
        F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"),
        F.sum("ss").over(whole).alias("ss"),
    ).where("n0 < n")
    n1 = F.col("n") - F.col("n0")
    mean = F.col("s") / F.col("n")
    variance = F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))
    inverse = 1.0 / F.col("n0") + 1.0 / n1
    log_term = F.log(F.lit(2.0) * F.col("n") / F.lit(delta))
    epsilon = F.sqrt(2.0 * inverse * variance * log_term) + F.lit(2.0 / 3.0) * inverse * log_term
    cuts = sums.select(
        key, "bucket", "n0", n1.alias("n1"),
        (F.col("s0") / F.col("n0")).alias("mean0"), ((F.col("s") - F.col("s0")) / n1).alias("mean1"),
        epsilon.alias("epsilon"),
    )
    return cuts.withColumn("is_cut", F.abs(F.col("mean0") - F.col("mean1")) >= F.col("epsilon"))
