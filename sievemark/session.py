"""The session's settings that the library relies on, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(cores: str = "*", partitions: int = 8, app: str = "sievemark", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass the cluster's own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # a stack trace for each column operation
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the one set in the context. Only on one machine (a local master, as in tests) a folder of our own is made and set; on a cluster that names none this is an error, as a machine's own folder would be lost with it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sievemark-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, for a table that is written once and read again."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def checkpointed(df):
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df):
    """df over at least as many partitions as the cluster has cores, for work that is heavy for each row.

    An input that fills the cluster stays as it is: only one that is too small for it (a single file, say) is shuffled, once.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
