"""Index tables in buckets, so that questions about paths join them without an exchange.

All tables of an index have the same number of buckets by `(package, path)`, where the path of a table is the
one it is asked by: a part's own, a tree node's, or the target of a link. Spark then knows that rows which
belong together lie in files of one number, in tables written in one go or by any number of appends.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake.operators.index import degrees
from packlake.operators.tree import tree_nodes
from packlake.session import configure

#: Tables of a bucketed index and the column that their buckets go by, besides the package.
BY = {"parts": "path", "nodes": "path", "links": "path", "degrees": "path"}


@dataclass
class BucketedIndex:
    """Tables below `path`, a folder that all machines share, as tables of the session's catalog.

    `buckets` is fixed when an index is first written: some 100 MB of the largest table for each bucket. A
    package of a third of all rows is spread over the buckets by its paths. Opening needs no catalog that
    outlives the session: tables are registered by their folders.
    """

    spark: SparkSession
    path: str
    buckets: int = 64

    def _name(self, table: str) -> str:
        return f"packlake_{zlib.crc32(self.path.encode()):08x}_{self.buckets}_{table}"

    def _registered(self, table: str, like: DataFrame | None = None) -> str:
        name = self._name(table)
        if not self.spark.catalog.tableExists(name):
            schema = like.schema if like is not None else self.spark.read.parquet(f"{self.path}/{table}").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            by = f"package, {BY[table]}"
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'"
            )
        return name

    def append(self, parts: DataFrame, rels: DataFrame) -> None:
        """Adds packages that are not there yet: their parts, tree nodes, resolved links, and degrees.

        An exchange by bucket puts the rows of a bucket into one file for each append.
        """
        configure(self.spark)
        nodes = tree_nodes(parts).withColumnRenamed("node", "path")
        links = rels.filter(F.col("target_mode") == "Internal").withColumn("path", F.col("resolved_target"))
        for table, df in {"parts": parts, "nodes": nodes, "links": links, "degrees": degrees(rels)}.items():
            name = self._registered(table, df)
            by = ["package", BY[table]]
            df.select(self.spark.table(name).columns).repartition(self.buckets, *by).write.insertInto(name)

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self._registered(table))

    def dangling(self) -> DataFrame:
        """Links whose target is neither a part nor an implied directory; bucket by bucket."""
        return self.table("links").join(self.table("nodes").select("package", "path"), ["package", "path"], "left_anti")

    def node_degrees(self) -> DataFrame:
        """`(package, path, kind, size, n_out, n_in)` of parts and implied directories; bucket by bucket."""
        facts = self.table("parts").select("package", "path", "kind", "size")
        known = self.table("nodes").select("package", "path").join(facts, ["package", "path"], "left")
        return known.join(self.table("degrees"), ["package", "path"], "left").select(
            "package",
            "path",
            "kind",
            "size",
            F.coalesce("n_out", F.lit(0)).alias("n_out"),
            F.coalesce("n_in", F.lit(0)).alias("n_in"),
        )
