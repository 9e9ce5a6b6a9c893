"""A session with the settings that the operators assume."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; the rest is left to the cluster."""
    builder = SparkSession.builder.appName("tarnlight").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` in the one that ``spark.checkpoint.dir`` names, removed when the driver ends.

    A temporary folder takes its place only where that is unset and the master is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tarnlight-"))
        root = spark.sparkContext.getCheckpointDir()
    folder = f"{root.rstrip('/')}/tarnlight/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended before; the folder's owner cleans up
            pass

    atexit.register(remove)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the scratch folder: many jobs read it, and none recomputes what led to it."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
