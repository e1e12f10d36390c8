"""Session and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "postlens", cores: str | int | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and benches; on a cluster use the existing one."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if os.environ.get("POSTLENS_JIT_HUGE", "0") == "1":
        # Opt-in: let the JIT compile huge generated methods (HotSpot
        # skips methods over 8000 bytecodes). Measured slower overall at sf0.1.
        builder = (builder.config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
                   .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session; only when it is unset (local
    tests) a folder of our own is chosen and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf = tempfile.mkdtemp(prefix="postlens-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table of our own in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/postlens/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Unlike a checkpoint its size is known to the planner, so later joins broadcast it only
    below ``spark.sql.autoBroadcastJoinThreshold`` (bytes).
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
