"""Running a streaming DataFrame to a Parquet sink."""
from headwise.session import work_path


_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def _drained(spark, writer):
    """Start ``writer`` over what is available.

    It runs no micro-batches without data: state that expires by the clock would ask for one after another and
    never stop. Windows that are still open are finished from the state (:mod:`headwise.streaming.summaries`).
    """
    before = spark.conf.get(_NO_DATA)
    spark.conf.set(_NO_DATA, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(_NO_DATA, before)


def start(stream, path, checkpoint, interval=None, mode="append"):
    """Start a file sink: continuous with ``interval`` ('30 seconds'), else drain and stop."""
    writer = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return writer.trigger(processingTime=interval).start() if interval else _drained(stream.sparkSession, writer)


def drain(stream, label):
    """Process everything available and return the sink's rows."""
    return drain_with_checkpoint(stream, label)[0]


def drain_with_checkpoint(stream, label):
    """The sink's rows, and the checkpoint that holds the state the stream ended with."""
    spark = stream.sparkSession
    path, checkpoint = work_path(spark, label), work_path(spark, f"{label}-offsets")
    start(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), checkpoint


def drain_batches(stream, write_batch, label):
    """Process everything available through ``write_batch(rows, batch_id)``."""
    spark = stream.sparkSession
    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", work_path(spark, f"{label}-offsets"))
    _drained(spark, writer).awaitTermination()
