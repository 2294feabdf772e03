"""Session settings used by tests, the bench and local runs.

On a cluster the submitter owns the session; nothing in the package needs these
settings except the ones ``prepare`` applies at run time.
"""
import os

from pyspark.sql import SparkSession


def local_session(cores: int = 8, app: str = "tickloom", **conf) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TICKLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # The ordered stream state (``streaming.stateful``) needs maps and timers.
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        # Small local data: keep the tasks apart instead of packing them into 1 MB each.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32KB")
        # Call-site capture costs several JVM round trips per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every plan of the package expects.

    Times are UTC. A frame already hashed on (symbol, block) may join on
    (symbol, strategy, block) without another exchange. Inferred IS NOT NULL filters are
    off: they differ between the readers of one exchange and would stop its reuse.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The reliable checkpoint folder the cluster names; a fallback only where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = named or fallback
    if folder and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settled(df):
    """The frame, its lineage ended by a checkpoint in the folder the session names.

    A session that names none gets a folder in its warehouse folder, which all executors share.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark, spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return df.checkpoint()
