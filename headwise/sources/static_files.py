"""Static dimension files (stops.txt, routes.txt), as a folder or inside a zip; columns go by header name."""
import csv
import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from headwise.schema import ROUTES_CSV, STOPS_CSV


def read_csv(spark, path, schema):
    """The named columns of a CSV with a header, as text, plus ``position``, the place in the file.

    Columns are found by the names in the header, in any order and among others; an absent one is null.
    Quotes follow RFC 4180: doubled quotes and line breaks inside a quoted field.
    """
    rows = (
        spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"')
        .option("multiLine", True).option("mode", "PERMISSIVE").csv(path)
    )
    found = {name.strip().removeprefix("\ufeff"): name for name in rows.columns}
    position = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    named = [
        (F.col(f"`{found[n]}`") if n in found else F.lit(None).cast("string")).alias(n) for n in schema.fieldNames()
    ]
    return rows.select(*named, position.alias("position"))


def read_zip_member(spark, path, member, schema):
    """The first member of each archive whose name ends with ``member``.

    One archive is one row of the binary source; a static feed is a few MB.
    """
    names = schema.fieldNames()

    def unpack(frames):
        for frame in frames:
            for source, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    found = [n for n in archive.namelist() if n.endswith(member)]
                    if not found:
                        continue
                    with archive.open(found[0]) as handle:
                        reader = csv.DictReader(io.TextIOWrapper(handle, encoding="utf-8-sig", newline=""))
                        reader.fieldnames = [n.strip() for n in reader.fieldnames or []]
                        rows = [[line.get(n) for n in names] for line in reader]
                out = pd.DataFrame(rows, columns=names)
                out["file"], out["row"] = source, range(len(out))
                yield out

    plain = ", ".join(f"{n} string" for n in names)
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(
        unpack, f"{plain}, file string, row long"
    )
    return rows.select(*names, F.struct("file", F.lit(0).cast("long").alias("block"), "row").alias("position"))


def stops_from_rows(rows):
    """Stops from file rows: the first row of an id counts, even if its
    coordinates turn out to be unreadable and the stop is dropped for it."""
    text = lambda name: F.trim(F.coalesce(F.col(name), F.lit("")))
    fields = F.struct(
        text("stop_name").alias("stop_name"),
        F.trim("stop_lat").try_cast("double").alias("lat"),
        F.trim("stop_lon").try_cast("double").alias("lon"),
    )
    first = (
        rows.withColumn("stop_id", text("stop_id")).where("stop_id <> ''")
        .groupBy("stop_id").agg(F.min_by(fields, F.col("position")).alias("first"))
    )
    return first.select("stop_id", "first.*", F.array().cast("array<string>").alias("routes")).where(
        F.col("lat").isNotNull() & F.col("lon").isNotNull()
    )


def stops_load(spark, path):
    if path.endswith(".zip"):
        return stops_from_rows(read_zip_member(spark, path, "stops.txt", STOPS_CSV))
    return stops_from_rows(read_csv(spark, path, STOPS_CSV))


def routes_from_rows(rows):
    return (
        rows.select(F.trim("route_id").alias("route_id")).where("route_id <> ''")
        .distinct().orderBy("route_id")
    )


def routes_static_load(spark, path):
    if path.endswith(".zip"):
        return routes_from_rows(read_zip_member(spark, path, "routes.txt", ROUTES_CSV))
    return routes_from_rows(read_csv(spark, path, ROUTES_CSV))
