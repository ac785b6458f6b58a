"""Stable hashes: feature hashing and dimension fingerprints."""
from pyspark.sql import functions as F


def stable_hash_unit(value, mod):
    """Leading 32 bits of MD5, reduced to [0, 1); empty or missing text gives 0."""
    head = F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("long")
    unit = (head % F.lit(mod)) / F.lit(float(mod))
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(0.0)).otherwise(unit)


#: Buckets of a fingerprint, by the leading hex digits of each id's MD5.
FINGERPRINT_BUCKET_DIGITS = 2


def set_fingerprint(ids, column):
    """Count and 16 hex digits of a digest of the set of ids, whatever their number.

    Ids are digested per bucket, in order, and the bucket digests again. Both levels are the same for every
    table, so adding an id never changes the formula.
    """
    text = F.col(column).cast("string")
    ids = ids.where(text.isNotNull()).select(text.alias("_id"))
    bucket = F.substring(F.md5(F.col("_id").cast("binary")), 1, FINGERPRINT_BUCKET_DIGITS)
    digest = lambda parts: F.sha1(F.array_join(F.array_sort(parts), ",").cast("binary"))
    buckets = ids.groupBy(bucket.alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_n"), digest(F.collect_list("_id")).alias("_digest"))
    parts = F.collect_list(F.concat("_bucket", F.lit(":"), "_digest"))
    return buckets.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.substring(digest(parts), 1, 16).alias("fingerprint"))
