"""Helpers shared by the corpus operators."""
from pyspark.sql import Window, functions as F

from headwise.session import ensure_checkpoint_dir, work_path, write_and_read

__all__ = ["SPACE_WORDS", "bound_memory", "ensure_checkpoint_dir", "fields", "power_of_two", "rank_in_parts", "space_words", "table", "without", "work_path", "write_and_read"]

# The word separators of the contracts that split on white space.
SPACE_WORDS = r"[\x20\x09-\x0D]+"


# Long texts make batches by rows and buffered row groups large: both are bounded by bytes for all corpus operators.
_MEMORY = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "parquet.block.size": str(32 << 20)}


def bound_memory(spark):
    """Bound what tasks hold of texts at once: Arrow batches and Parquet row groups, by bytes."""
    for name, value in _MEMORY.items():
        spark.conf.set(name, value)


def table(spark, sf_dir, name):
    bound_memory(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(df, *names):
    """Only the named columns, so that extra columns cannot clash; a missing one is null."""
    bound_memory(df.sparkSession)
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).alias(n) for n in names])


def space_words(text):
    """Words between ASCII white space as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_WORDS), "")


def power_of_two(n):
    return 1 << max(0, int(n - 1).bit_length())


def rank_in_parts(df, key, parts, order, name):
    """Add ``name``: the gapless place of a row within ``key``, by ``parts`` and then ``order``.

    A key may hold most of the rows; only the rows of one part are numbered in one task. The parts of a key
    are counted first, and a row's place is the count of the earlier parts plus its place in its own. ``df``
    is read twice.
    """
    before = Window.partitionBy(*key).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = write_and_read(
        df.groupBy(*key, *parts).agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows"), "offsets")
    own = F.row_number().over(Window.partitionBy(*key, *parts).orderBy(*order)) - 1
    return df.join(offsets, [*key, *parts]).withColumn(name, F.col("_offset") + own).drop("_offset")


def without(docs, unwanted):
    """``docs`` less the rows whose doc_id and text digest are in ``unwanted`` (doc_id, digest)."""
    keys = write_and_read(unwanted.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct(), "unwanted")
    same = docs["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(docs["text"]) == keys["_digest"])
    return docs.join(keys, same, "left_anti")
