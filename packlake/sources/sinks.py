"""The index of a corpus as parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_index(
    tables: dict[str, DataFrame], path: str, buckets: int = 64, mode: str = "overwrite"
) -> None:
    """Each table under `path/<name>`, split by a hash bucket of the package.

    The rows are spread by `(bucket, hash of the row)` rather than by package, so one huge
    package does not end in one writer task.
    """
    for name, df in tables.items():
        bucket = F.pmod(F.xxhash64("package"), F.lit(buckets)).cast("int")
        (
            df.withColumn("bucket", bucket)
            .repartition(F.col("bucket"), F.pmod(F.xxhash64(*df.columns), F.lit(16)))
            .write.mode(mode)
            .partitionBy("bucket")
            .parquet(f"{path.rstrip('/')}/{name}")
        )


def read_index(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}").drop("bucket")
