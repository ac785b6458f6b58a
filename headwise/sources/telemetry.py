"""Telemetry documents as JSON files."""
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from headwise.schema import TELEMETRY

_TEXT = "value string"


def telemetry_write(row, path):
    """One-row DataFrame to one JSON document, replacing the previous one."""
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _document(spark, path):
    """(text, exists): a path nobody has written yet is one row without text."""
    try:
        return spark.read.schema(_TEXT).text(path, wholetext=True).select("value")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(1).select(F.lit(None).cast("string").alias("value"))


def _with_status(document):
    """available / unavailable (missing or no object) / error (not JSON)."""
    parsed = document.withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    status = (
        F.when(F.col("value").isNull(), "unavailable")
        .when(F.col("v").isNull(), "error")
        .when(kind.startswith("OBJECT"), "available")
        .otherwise("unavailable")
    )
    return parsed.withColumn("status", status)


def telemetry_read(spark, path, fields=TELEMETRY.fields):
    """Status and the known telemetry fields; other keys are ignored."""
    rows = _with_status(_document(spark, path))
    known = F.when(F.col("status") == "available", F.col("v"))
    return rows.select(
        "status",
        *[F.try_variant_get(known, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields],
    )


def telemetry_read_all(spark, path):
    """Status and the whole document, passed through."""
    rows = _with_status(_document(spark, path))
    return rows.select(
        "status", F.when(F.col("status") == "available", F.to_json("v")).alias("document")
    )


# Shadow fields shown by the health check.
SHADOW_HEALTH_FIELDS = [
    ("model", "string"),
    ("samples_used", "bigint"),
    ("recon_error_p99", "double"),
    ("shadow_alerts_high", "bigint"),
    ("corr_with_online_score", "double"),
    ("last_run_utc", "string"),
]


def shadow_health_read(spark, path):
    rows = _with_status(_document(spark, path))
    known = F.when(F.col("status") == "available", F.col("v"))
    return rows.select(
        "status",
        *[F.try_variant_get(known, f"$.{n}", t).alias(n) for n, t in SHADOW_HEALTH_FIELDS],
    )
