"""Session settings the library relies on, and the folder its jobs share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"

def build_session(app: str = "tidemark", cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, pass your own session."""
    n = cores or 8
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every query needs, whoever made the session.

    Times are compared in UTC. A stream's sessions are merged inside each map task before
    the shuffle, so that a busy user arrives as a few sessions and not as all its events.
    State is kept in RocksDB, on disk, since users outgrow an executor's memory; what a
    micro-batch adds to it is all that its checkpoint writes.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path under the folder all executors see, for checkpoints and written tables.

    The cluster names that folder in ``spark.checkpoint.dir``, or the job has set it on the
    context. A machine-local folder stands in for it only when the whole of Spark runs on
    this machine.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
