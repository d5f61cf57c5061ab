"""Incremental indexing of arriving packages with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packlake.limits import DEFAULT, Limits
from packlake.operators.index import build_index
from packlake.session import Scratch, discard
from packlake.sources.packages import PACKAGE_GLOB, explode_packages

BLOB_SCHEMA = "package string, content binary"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_packages(
    spark: SparkSession,
    path: str,
    fmt: str = "binaryFile",
    glob: str = PACKAGE_GLOB,
    max_files: int | None = None,
) -> DataFrame:
    """Arriving packages as a stream `(package, content)`. A path is read once: a file that is
    rewritten in place is not seen again, so arrivals must be immutable."""
    reader = spark.readStream.format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "parquet":
        return reader.schema(BLOB_SCHEMA).load(path)
    return (
        reader.schema(FILE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.col("path").alias("package"), "content")
    )


def index_stream(
    packages: DataFrame, out: str, checkpoint: str, limits: Limits = DEFAULT
) -> StreamingQuery:
    """Indexes each arriving package once; tables go to `out/<table>/batch=<n>`.

    A batch writes its own folder with overwrite, so one that is repeated after a failure
    replaces itself. What it staged on the way is removed when its tables are written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = f"{out.rstrip('/')}/_entries/batch={batch_id}"
        # Each package is opened once per batch; the tables read what that wrote.
        explode_packages(batch, limits=limits).write.mode("overwrite").parquet(base)
        entries = spark.read.parquet(base)
        with Scratch(spark) as scratch:
            for name, df in build_index(entries, limits, scratch.staged).items():
                df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}/batch={batch_id}")
        discard(spark, base)

    return (
        packages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
