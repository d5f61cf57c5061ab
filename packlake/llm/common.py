"""Helpers shared by the operators: tables, hash splits, Arrow columns, the scratch folder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def is_held_out(doc_id: str, modulus: int, value: int = 0) -> Column:
    """False for a null id."""
    return F.coalesce(remainder(doc_id, modulus) == F.lit(value), F.lit(False))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


#: Letters A-Z to a-z; `bytes.lower` does just that, and `bytes.split` splits at [\x20\x09-\x0D].
def lower_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()
