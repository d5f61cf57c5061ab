"""An index of packages that change in place: versions, and the differences between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake.functions.paths import normalize_path
from packlake.limits import DEFAULT, Limits
from packlake.session import Scratch, _file_system
from packlake.sources.packages import explode_packages

MANIFEST = "package string, digest string, modified timestamp, version int"
PARTS = "package string, path string, size bigint, digest string, version int"
CHANGES = "package string, path string, change string, version int"
POINTER = "current.txt"


class VersionedIndex:
    """Folder `path` with `manifest/version=n`, `parts/version=n`, `changes/version=n` and the number of the current version.

    A refresh compares the digests of packages with the manifest and opens only those that are new or
    changed; their parts are written under the new version, the manifest tells under which version the
    parts of each package are. Readers see a version when the pointer is renamed into place, so a refresh
    that fails or is repeated leaves the current one whole, and one that finds nothing new makes none.
    """

    def __init__(self, spark: SparkSession, path: str, limits: Limits = DEFAULT):
        self.spark, self.path, self.limits = spark, path.rstrip("/"), limits

    # Versions.
    def current(self) -> int:
        """The number of the current version, 0 before the first."""
        files, where = _file_system(self.spark, f"{self.path}/{POINTER}")
        if not files.exists(where):
            return 0
        return int(self.spark.read.text(f"{self.path}/{POINTER}").first()[0])

    def _switch(self, version: int) -> None:
        jvm = self.spark._jvm
        files, where = _file_system(self.spark, f"{self.path}/{POINTER}.{version}")
        out = files.create(where, True)
        out.write(bytearray(str(version).encode()))
        out.close()
        # A rename in place of what is there: readers find the old number or the new one.
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration())
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context.rename(where, jvm.org.apache.hadoop.fs.Path(f"{self.path}/{POINTER}"), how)

    def _table(self, name: str, version: int, schema: str) -> DataFrame:
        files, where = _file_system(self.spark, f"{self.path}/{name}/version={version}")
        if not files.exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/version={version}")

    def manifest(self, version: int | None = None) -> DataFrame:
        """The packages of a version, by default the current one."""
        return self._table("manifest", self.current() if version is None else version, MANIFEST)

    def parts(self, version: int | None = None) -> DataFrame:
        """The parts of a version: of each package those that were written when it last changed."""
        version = self.current() if version is None else version
        manifest = self.manifest(version).select("package", "version")
        files, where = _file_system(self.spark, f"{self.path}/parts")
        if not files.exists(where):
            return self.spark.createDataFrame([], PARTS)
        written = self.spark.read.option("basePath", f"{self.path}/parts").schema(PARTS).parquet(f"{self.path}/parts")
        return written.filter(F.col("version") <= version).join(manifest, ["package", "version"])

    def changes(self, version: int) -> DataFrame:
        """`(package, path, change, version)`: parts added, removed or changed by a version."""
        return self._table("changes", version, CHANGES).withColumn("version", F.lit(version))

    # Refresh.
    def refresh(self, packages: DataFrame, complete: bool = True) -> int:
        """Brings the index up to `packages` `(package, content[, modified])`; the version that is current then.

        Packages that are not among them are removed if `complete`, else they stay. Of repeated packages
        the one modified last counts, and of those the one with the greatest digest. A package that cannot
        be opened has no parts. No packages, or no changes, make no version.
        """
        old = self.current()
        version = old + 1
        if "modified" not in packages.columns:
            packages = packages.withColumn("modified", F.lit(None).cast("timestamp"))
        with Scratch(self.spark) as scratch:
            seen = packages.select("package", F.sha2("content", 256).alias("digest"), "modified")
            newest = F.max(F.struct("modified", "digest")).alias("n")
            seen = scratch.staged(seen.groupBy("package").agg(newest).select("package", "n.digest", "n.modified"), "seen")
            before = self.manifest(old)
            same = before.select("package", "digest")
            touched = scratch.staged(seen.join(same, ["package", "digest"], "left_anti"), "touched")
            gone = before.join(seen, "package", "left_anti").select("package") if complete else before.select("package").limit(0)
            gone = scratch.staged(gone, "gone")
            if touched.isEmpty() and gone.isEmpty():
                return old
            # Bytes stay where they are: the few changed digests go to the packages, where they are small.
            opened = packages.withColumn("digest", F.sha2("content", 256)).join(touched.select("package", "digest"), ["package", "digest"], "left_semi")
            entries = explode_packages(opened.select("package", "content"), with_content=True, limits=self.limits)
            path = F.concat(F.lit("/"), normalize_path("archive_name"))
            fresh = entries.filter((F.col("ord") >= 0) & ~F.col("is_dir") & (F.col("copy") == 0)).select(
                "package", path.alias("path"), "size", F.coalesce(F.sha2("content", 256), F.col("read_error")).alias("digest")
            )
            fresh.distinct().write.mode("overwrite").parquet(f"{self.path}/parts/version={version}")
            fresh = self.spark.read.parquet(f"{self.path}/parts/version={version}")
            changed = touched.select("package").unionByName(gone)
            was = self.parts(old).join(changed, "package", "left_semi").select("package", "path", F.col("digest").alias("was"))
            both = was.join(fresh.select("package", "path", "digest"), ["package", "path"], "full")
            change = (
                F.when(F.col("was").isNull(), "added")
                .when(F.col("digest").isNull(), "removed")
                .when(F.col("was") != F.col("digest"), "changed")
            )
            differing = both.select("package", "path", change.alias("change")).filter("change is not null")
            differing.write.mode("overwrite").parquet(f"{self.path}/changes/version={version}")
            kept = before.join(changed, "package", "left_anti").select("package", "digest", "modified", "version")
            added = touched.select("package", "digest", "modified", F.lit(version).alias("version"))
            kept.unionByName(added).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        self._switch(version)
        return version
