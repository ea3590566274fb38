"""SparkSession factory with the settings the operators are planned for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lumenquery", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with UTC, AQE (coalescing and skew joins) and Arrow; a master is set only when one is given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder of spark.checkpoint.dir and read again; on one machine a temporary folder does."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if base is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="ckpt-"))
    return df.checkpoint()
