"""Session settings and the shared checkpoint folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def build_session(app="comarca", master=None, **settings):
    """A session with the settings the operators expect; cluster settings are left alone."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark):
    """The shared folder named by the cluster; a scratch folder only for local masters."""
    context = spark.sparkContext
    shared = spark.conf.get(CHECKPOINT, None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT} to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="comarca-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared)
    return shared


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``durable`` for many rows: compressed files by column in the checkpoint folder, so later steps read what they need."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
