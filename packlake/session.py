"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import packlake

# Runtime settings; all can be changed on a live session.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even when that costs one more shuffle above the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Estimates say nothing about what a container or a tokeniser emits: only sizes measured at run
    # time decide about a broadcast.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10485760",
    # Per-package caps go up to 16,384 rows: keep the map-side top-k for all of them.
    "spark.sql.optimizer.windowGroupLimitThreshold": "16384",
    # Package rows can hold megabytes each: bound batches by bytes as well as by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
    "spark.sql.session.timeZone": "UTC",
}


# Settings a session must be started with; useful, not required.
START = {
    # Plans here have many expressions; do not record a Python call site for each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", memory: str = "12g") -> SparkSession:
    """A session on this machine, for tests and measurements."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        # One machine: its temporary folder is shared by all there is.
        "spark.checkpoint.dir": os.environ.get("SPARK_CHECKPOINT_DIR", f"{tempfile.gettempdir()}/spark-checkpoints"),
    }
    for key, value in (START | RUNTIME | settings).items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    # Task functions travel with the job, so executors need no copy of this package.
    cloudpickle.register_pickle_by_value(packlake)
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for `purpose` in the checkpoint folder that all machines of the cluster share.

    There is no other place that tasks could read back from, so a session without one is an error. The
    folder is removed when the session ends, or before that by `discard`.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    return path


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder, where there is one."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """`df` as a table in the shared folder, for results that several plans read.

    This cuts the lineage: what comes after is planned from a plain scan, the work before is
    done once, and a lost executor re-reads files instead of redoing it.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Tables staged within a `with` block, removed at its end; for results written before that."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for path in self.paths:
            discard(self.spark, path)

    def staged(self, df: DataFrame, purpose: str) -> DataFrame:
        path = shared_dir(self.spark, purpose)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.parquet(path)
