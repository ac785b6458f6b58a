"""Session defaults and the shared working folder."""
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Runtime settings the operators rely on: UTC clock fields, AQE for skewed
# joins and partition coalescing, a disk-backed state store for keyed streams.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": _STATE_STORE,
}


def build_session(app_name="headwise", master=None, **conf):
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark):
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark):
    """Return the shared folder; only a local session may fall back to /tmp."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if configured is None:
            # Not local-cluster: its executors are processes of their own.
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="headwise-")
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    return configured or current


def work_path(spark, label):
    """A new, unused path under the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_and_read(df, label, partition_by=(), **options):
    """Materialise ``df`` as a Parquet table in the shared folder and read it back; ``options`` are the writer's."""
    path = work_path(df.sparkSession, label)
    df.write.options(**options).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
