"""Session helpers: a local session for tests and benches, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tallyward") -> SparkSession:
    """Session for tests and benches; on a cluster, callers bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def working_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stage tables.

    It is the one the session names in ``spark.checkpoint.dir``. Only a local session may
    go without one and then gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    active = sc.getCheckpointDir()
    if active:
        return active
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="tallyward-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, so no run ever overwrites another."""
    return f"{working_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
