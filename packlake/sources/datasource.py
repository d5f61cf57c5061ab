"""Package files as a data source that reads the directory of a container and the entries asked for.

`spark.read.format("packages")` has the rows of `explode_packages`, but opens files by ranges: the central
directory at the end of a file, then the bytes of the entries whose content is wanted. Filters on names,
sizes and positions are pushed into the reader, so entries that they leave out are never read. A file of
any size can be opened, since it is never a row.
"""

from __future__ import annotations

import fnmatch
import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from packlake.limits import DEFAULT, Limits, bound
from packlake.session import configure
from packlake.sources import compound
from packlake.sources.packages import (
    ENTRY_SCHEMA,
    Ranges,
    _clean_name,
    _entry_batch,
    _is_metadata,
    _over_limits,
    bounded_read,
)

#: Files and bytes of one task.
TASK_FILES, TASK_BYTES = 1000, 256 << 20
_FLUSH_BYTES, _FLUSH_ROWS = 16 << 20, 4096
#: A file up to this size is one read; its directory alone may need as much.
SMALL_FILE = 1 << 16
#: Filters that the reader applies itself, on these columns.
PUSHED = ("package", "archive_name", "size", "compressed_size", "ord")
TESTS = {
    EqualTo: lambda value, want: value == want,
    In: lambda value, want: value in want,
    GreaterThan: lambda value, want: value > want,
    GreaterThanOrEqual: lambda value, want: value >= want,
    LessThan: lambda value, want: value < want,
    LessThanOrEqual: lambda value, want: value <= want,
    StringStartsWith: lambda value, want: value.startswith(want),
    StringEndsWith: lambda value, want: value.endswith(want),
    StringContains: lambda value, want: want in value,
}


@dataclass
class Files(InputPartition):
    files: list[tuple[str, str, int]]  # name of the package, path in the file system, size


class PackageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.glob = re.compile("|".join(fnmatch.translate(g) for g in options.get("glob", "*.pptx,*.docx,*.xlsx").split(",")))
        self.content = options.get("content", "metadata")
        if self.content not in ("none", "metadata", "all"):
            raise ValueError("option `content` is none, metadata or all")
        limit = options.get("limit")
        self.limits: Limits = DEFAULT
        self.limit = int(limit) if limit else None
        #: (column, kind of test, value), all of which must hold
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            column = ".".join(getattr(one, "attribute", ()))
            if type(one) in TESTS and column in PUSHED and getattr(one, "value", None) is not None:
                self.tests.append((column, type(one), one.value))
            else:
                yield one

    def passes(self, **values) -> bool:
        """Whether the tests on these columns hold; a null passes none, as in SQL."""
        return all(
            values[column] is not None and TESTS[kind](values[column], want)
            for column, kind, want in self.tests
            if column in values
        )

    def partitions(self) -> list[Files]:
        files, root = fs.FileSystem.from_uri(self.folder) if ":/" in self.folder else (fs.LocalFileSystem(), self.folder)
        chosen = []
        for info in files.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type == fs.FileType.File and self.glob.match(info.base_name) and self.passes(package=info.base_name):
                chosen.append((info.size, info.base_name, info.path))
        tasks, size = [Files([])], 0
        for n, name, path in sorted(chosen, reverse=True):
            # Only ranges of a large file are read, but a task holds one at a time.
            if tasks[-1].files and (size + n > TASK_BYTES or len(tasks[-1].files) >= TASK_FILES):
                tasks.append(Files([]))
                size = 0
            tasks[-1].files.append((name, path, n))
            size += n
        return tasks

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files = fs.FileSystem.from_uri(self.folder)[0] if ":/" in self.folder else fs.LocalFileSystem()
        rows: list[tuple] = []
        held = 0
        for package, path, size in partition.files:
            with files.open_input_file(path) as file:
                if size <= SMALL_FILE:
                    file = io.BytesIO(file.read())
                for row in self.entries(package, Ranges(file)):
                    rows.append(row)
                    held += len(row[6] or b"")
                    if held >= _FLUSH_BYTES or len(rows) >= _FLUSH_ROWS:
                        yield _entry_batch(rows)
                        rows, held = [], 0
        if rows:
            yield _entry_batch(rows)

    def entries(self, package: str, file: Ranges) -> Iterator[tuple]:
        """Rows of one package, of which `file` only gives the ranges that they need."""
        cap = min(bound(self.limit), bound(self.limits.entry_bytes))
        if self.content != "all":
            cap = min(cap, bound(self.limits.metadata_bytes))
        try:
            infos = zipfile.ZipFile(file).infolist()
            problem = _over_limits(infos, self.limits)
        except Exception as error:  # any damage ends as a diagnostic, never as a failed job
            infos, problem = [], compound.problem_of_file(file) or str(error)
        if problem is not None:
            if self.passes(ord=-1, archive_name=None, size=0, compressed_size=0):
                yield (package, -1, None, False, 0, 0, None, problem, 0)
            return
        seen: Counter[str] = Counter()
        for ord_, info in enumerate(infos):
            name = info.orig_filename
            path = _clean_name(name)
            copy, is_dir = seen[path], name.endswith(("/", "\\"))
            seen[path] += 1
            if not self.passes(ord=ord_, archive_name=name, size=info.file_size, compressed_size=info.compress_size):
                continue
            content = read_error = None
            if self.content == "all" and not is_dir or self.content == "metadata" and _is_metadata(name):
                content, read_error = bounded_read(file, info, cap)
            yield (package, ord_, name, is_dir, info.file_size, info.compress_size, content, read_error, copy)


class PackageSource(DataSource):
    """Options: `path`, `content` (none, metadata or all), `glob` (by commas), `limit` in bytes of an entry."""

    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return ENTRY_SCHEMA

    def reader(self, schema) -> PackageReader:
        return PackageReader(self.options)


def read_packages(spark: SparkSession, path: str, content: str = "metadata", **options: str) -> DataFrame:
    """The entries of the packages below `path`, with the columns of `explode_packages`; `package` is the
    file's name. Bytes are read for entries that pass the filters on names, sizes and positions, and are
    wanted by `content`: none, those of metadata parts, or all."""
    configure(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackageSource)
    reader = spark.read.format("packages").option("content", content)
    return reader.options(**options).load(path)


def write_packages(packages: DataFrame, path: str, ending: str = "") -> int:
    """Each row `(package, content)` as a file below `path`, which all machines share; how many there are.

    A repeated task writes the same files again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for package, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_output_stream(f"{root}/{package}{ending}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    written = packages.select("package", "content").mapInArrow(write, "n long")
    return written.agg({"n": "sum"}).first()[0] or 0
