"""Versioned learner state as a Parquet table."""
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

STATE = T.StructType([
    T.StructField("route_id", T.StringType()),
    T.StructField("rows_seen", T.LongType()),
    T.StructField("mae_ema", T.DoubleType()),
    T.StructField("drift_events", T.LongType()),
    T.StructField("state", T.StringType()),
])


def _save(rows, path, version):
    """Store one version, e.g. a UTC time text; saving it again replaces it."""
    rows.withColumn("version", F.lit(version)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def save_state(states, tail, path, version):
    """The states of all routes and the rows they look back on, as one version."""
    _save(tail, f"{path}/tail", version)
    # The states come last: a version counts from when they are there.
    _save(states.select(*STATE.fieldNames()), f"{path}/states", version)


def _newest(spark, path, schema, before=None):
    """Rows of the newest version (below ``before``); empty if none was written or it is unreadable."""
    stored = T.StructType(schema.fields + [T.StructField("version", T.StringType())])
    try:
        table = spark.read.schema(stored).option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stored)
    if before is not None:
        table = table.where(F.col("version") < before)
    return table.where(F.col("version") == table.agg(F.max("version")).scalar())


def load_state(spark, path, before=None):
    return _newest(spark, f"{path}/states", STATE, before)


def load_tail(spark, path, schema, before=None):
    return _newest(spark, f"{path}/tail", schema, before)


WEIGHTS = T.StructType([T.StructField("weights", T.ArrayType(T.DoubleType()))])


def save_weights(spark, weights, path, version):
    """Shadow model weights, about 2500 numbers, as one row per version."""
    _save(spark.createDataFrame([([float(w) for w in weights],)], WEIGHTS), path, version)


def load_weights(spark, path):
    row = _newest(spark, path, WEIGHTS).first()
    return row["weights"] if row else None
