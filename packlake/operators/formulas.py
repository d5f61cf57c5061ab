"""References of formulas, and the order in which they can be computed."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from packlake.operators.ranges import RECTANGLE, contained, placed, positioned
from packlake.session import Scratch, staged

#: Links of one package up to which its formulas are ordered in one task.
LOCAL_LINKS = 500_000
#: Different defined names up to which they are sent to all tasks.
BROADCAST_NAMES = 100_000
_FLUSH_ROWS = 20_000
_STRING = r'"(?:[^"]|"")*"'
_SHEET = r"(?:'((?:[^']|'')+)'|([\p{L}_][\p{L}0-9_.]*))!"
_CELL = r"\$?[A-Za-z]{1,3}\$?[0-9]{1,7}"
_AREA = rf"{_CELL}(?::{_CELL})?|\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}}|\$?[0-9]{{1,7}}:\$?[0-9]{{1,7}}"
_BEFORE, _AFTER = r"(?<![\p{L}0-9_.!'$\]:])", r"(?![\p{L}0-9_.(!:])"
REFERENCE = rf"{_BEFORE}(?:{_SHEET})?({_AREA}){_AFTER}"
NAME = rf"{_BEFORE}[\p{{L}}_][\p{{L}}0-9_.]*{_AFTER}"


def _code(formula: str) -> Column:
    """The formula without what its texts hold."""
    return F.when(F.contains(formula, F.lit('"')), F.regexp_replace(formula, _STRING, '""')).otherwise(F.col(formula))


def formula_references(cells: DataFrame, sheets: DataFrame, names: DataFrame | None = None, distinct: bool = True) -> DataFrame:
    """`(package, path, ord, ref_path, …RECTANGLE)`: the ranges that formulas read, once for each formula.

    `cells` are `worksheet_cells`; `sheets` (`workbook_sheets`) tell the part of a sheet that a reference
    names, without one it is the formula's own. Texts in quotes, function names and other workbooks are no
    references; a sheet that does not exist has no part and gives no row. `names` are `defined_names`, whose
    letters count in either case, and of which those of the formula's sheet come before global ones.
    Without `distinct` a formula may have a range more than once, and those of its own sheet are not shuffled.
    """
    code = cells.filter("formula is not null").select("package", "path", "ord", _code("formula").alias("code"))
    whole = rf"\A{REFERENCE}\z"
    far = F.contains("token", F.lit("!"))

    def tokens(code: DataFrame) -> DataFrame:
        return code.select("package", "path", "ord", F.explode(F.regexp_extract_all("code", F.lit(REFERENCE), 0)).alias("token"))

    # A reference names a sheet if there is a `!` in it; one without is an area as it stands.
    near = placed(tokens(code).filter(~far), "token")
    sheet = F.concat(
        F.replace(F.regexp_extract("token", whole, 1), F.lit("''"), F.lit("'")), F.regexp_extract("token", whole, 2)
    )
    found = tokens(code.filter(F.contains("code", F.lit("!")))).filter(far).select(
        "package", "path", "ord", sheet.alias("sheet"), F.regexp_extract("token", whole, 3).alias("area")
    )
    found = placed(found, "area").drop("area")
    parts = sheets.filter("path is not null").groupBy("package", F.lower("name").alias("sheet_key")).agg(F.min_by("path", "ord").alias("named_path"))
    own = near.select("package", "path", "ord", F.col("path").alias("ref_path"), *RECTANGLE)
    other = found.withColumn("sheet_key", F.lower("sheet")).join(parts, ["package", "sheet_key"])
    refs = own.unionByName(other.select("package", "path", "ord", F.col("named_path").alias("ref_path"), *RECTANGLE))
    if names is not None:
        words = code.select("package", "path", "ord", F.explode(F.regexp_extract_all("code", F.lit(NAME), 0)).alias("word"))
        words = words.withColumn("word", F.lower("word"))
        told = staged(names.select(F.lower("name").alias("word")).distinct(), "names")
        # Most words are cells; where the names are few, none that no package defines is shuffled.
        if told.count() <= BROADCAST_NAMES:
            words = words.join(F.broadcast(told), "word", "left_semi")
        words = words.distinct()
        places = sheets.select("package", "path", (F.col("ord") - 1).alias("place"))
        words = words.join(places, ["package", "path"], "left")
        known = names.withColumn("word", F.lower("name")).withColumn("sheet_key", F.lower("sheet")).join(parts, ["package", "sheet_key"])
        met = words.join(known.drop("ord", "path"), ["package", "word"]).filter(
            F.col("local_sheet").isNull() | (F.col("local_sheet") == F.col("place"))
        )
        nearest = met.groupBy("package", "path", "ord", "word").agg(F.bool_or(F.col("local_sheet").isNotNull()).alias("is_local"))
        met = met.join(nearest, ["package", "path", "ord", "word"]).filter(F.col("is_local") == F.col("local_sheet").isNotNull())
        refs = refs.unionByName(met.select("package", "path", "ord", F.col("named_path").alias("ref_path"), *RECTANGLE))
    return refs.distinct() if distinct else refs


def formula_links(cells: DataFrame, references: DataFrame) -> DataFrame:
    """`(package, before, after)`: what must be computed before what, among formulas and the ranges they read.

    Formulas are `c:part:ord`, ranges `r:part:top:first:bottom:last`. A range that many formulas read is one
    node, so it is matched with its cells once. Ranges without formulas give no row.
    """
    ranges = references.select("package", F.col("ref_path").alias("path"), *RECTANGLE).distinct()
    points = positioned(cells.filter("formula is not null").select("package", "path", "ord", "reference"))
    cell = F.concat_ws(":", F.lit("c"), "path", "ord")

    def of_range(path: str) -> Column:
        return F.concat_ws(":", F.lit("r"), path, *RECTANGLE)

    inside = contained(points, ranges, ["package", "path"]).select("package", cell.alias("before"), of_range("path").alias("after"))
    read = references.select("package", of_range("ref_path").alias("before"), cell.alias("after"))
    filled = inside.select("package", F.col("after").alias("before")).distinct()
    return inside.unionByName(read.join(filled, ["package", "before"], "left_semi"))


def _ordered(links: Iterator[tuple[str, str]]) -> dict[str, int]:
    """Levels of one package, by taking nodes whose links are all served; what is left is on or behind a cycle."""
    waiting, behind = defaultdict(int), defaultdict(list)
    for before, after in links:
        waiting[after] += 1
        behind[before].append(after)
    ready = [node for node in behind if node not in waiting]
    level = {node: int(node.startswith("c")) for node in ready}
    done = []
    while ready:
        node = ready.pop()
        done.append(node)
        for after in behind.pop(node, ()):
            level[after] = max(level.get(after, 0), level[node] + after.startswith("c"))
            waiting[after] -= 1
            if not waiting[after]:
                ready.append(after)
    return {node: level[node] for node in done if node.startswith("c")}


def _level_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of packages whose links (package, before, after) come one package after the other."""
    links = (link for batch in batches for link in zip(*(column.to_pylist() for column in batch.columns)))
    rows: list[tuple] = []
    for package, own in groupby(links, key=lambda link: link[0]):
        rows += [(package, *found) for found in _ordered(link[1:] for link in own).items()]
        if len(rows) >= _FLUSH_ROWS:
            yield _levels(rows)
            rows = []
    if rows:
        yield _levels(rows)


def _levels(rows: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.int32()))]
    return pa.RecordBatch.from_arrays(arrays, ["package", "node", "level"])


def _levels_of(formulas: list[tuple], references: list[tuple]) -> list[int | None]:
    """Levels of one package's formulas, none on or behind a cycle.

    Rows are (package, path, ord, ref_path, …RECTANGLE); a formula has its cell there, or 0, and no ref_path.
    """
    place: dict[tuple, int] = {}
    nodes = [place.setdefault(formula[1:3], len(place)) for formula in formulas]
    columns: dict[str, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for node, formula in zip(nodes, formulas):
        if formula[4]:
            columns[formula[1]][formula[5]].append((formula[4], node))
    # Rows in order, and their nodes.
    columns = {path: {c: tuple(zip(*sorted(at))) for c, at in of_path.items()} for path, of_path in columns.items()}
    readers: dict[tuple, set[int]] = defaultdict(set)
    for reference in references:
        reader = place.get(reference[1:3])
        if reader is not None:
            readers[reference[3:8]].add(reader)
    lies_in: list[list[tuple]] = [[] for _ in place]
    left, waits = {}, [0] * len(place)
    for area, by in readers.items():
        path, top, first, bottom, last = area
        of_path = columns.get(path, {})
        n = 0
        for column in (first,) if first == last else [c for c in of_path if first <= c <= last]:
            if column in of_path:
                rows, at = of_path[column]
                inside = at[bisect_left(rows, top) : bisect_right(rows, bottom)]
                n += len(inside)
                for node in inside:
                    lies_in[node].append(area)
        if n:
            left[area] = n
            for node in by:
                waits[node] += 1
    level, highest = [1] * len(place), dict.fromkeys(left, 0)
    ready = [node for node, n in enumerate(waits) if not n]
    while ready:
        node = ready.pop()
        own = level[node]
        for area in lies_in[node]:
            left[area] -= 1
            if own > highest[area]:
                highest[area] = own
            if not left[area]:
                above = highest[area] + 1
                for reader in readers[area]:
                    if above > level[reader]:
                        level[reader] = above
                    waits[reader] -= 1
                    if not waits[reader]:
                        ready.append(reader)
    return [None if waits[node] else level[node] for node in nodes]


def _values(column: pa.Array) -> list:
    """Numbers and texts without a Python call for each; no number is 0."""
    if pa.types.is_integer(column.type):
        return column.fill_null(0).to_numpy().tolist()
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(column.type) else column.to_pylist()


def _ordered_packages(batches: Iterator[pa.RecordBatch], local_links: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Levels of packages whose formulas (without ref_path) and references come one package after the other.

    The links of a package are at most as many as its references hold cells, or formulas, each. One that may have
    more than `local_links` is not kept, and has a row that says so.
    """
    rows: list[tuple] = []
    given = (row for batch in batches for row in zip(*(_values(column) for column in batch.columns)))
    for package, own in groupby(given, key=itemgetter(0)):
        formulas, references, n = [], [], 0
        for row in own:
            n += 1
            if n <= local_links:
                (formulas if row[3] is None else references).append(row)
            else:
                formulas, references = [], []
        cells = sum((row[6] - row[4] + 1) * (row[7] - row[5] + 1) for row in references)
        if n + min(cells, len(formulas) * len(references)) > local_links:
            rows.append((package, None, None, None, None, True, *(None for _ in row[8:])))
            continue
        for formula, level in zip(formulas, _levels_of(formulas, references)):
            rows.append((*formula[:3], level, level is None, False, *formula[8:]))
        if len(rows) >= _FLUSH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def formula_levels(cells: DataFrame, references: DataFrame, local_links: int = LOCAL_LINKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """`(package, path, ord, level, in_cycle, …keep)` of every formula; `keep` are columns of `cells` to go along.

    Level 1 reads no other formula, any other one is one above the highest it reads. A formula on a cycle,
    or that reads one that is, has no level and `in_cycle`. A package's formulas and references come to one task,
    which orders it if they cannot make too many links. Of the others the links are made by joins; where they are
    counted to be few enough, they are ordered in one task, and those of larger ones are peeled round by round, each
    round taking the formulas that wait for nothing. A cell whose reference names no cell is read by none.
    `references` may have rows more than once.
    """
    at = placed(cells.filter("formula is not null").select("package", "path", "ord", "reference", *(F.col(c).alias(f"_{c}") for c in keep)), "reference", outer=True)
    single = (F.col("top") == F.col("bottom")) & (F.col("first_column") == F.col("last_column"))
    key, carried = ["package", "path", "ord"], [f"_{c}" for c in keep]
    formulas = at.select(
        *key, F.lit(None).cast("string").alias("ref_path"), *(F.when(single, F.col(c)).alias(c) for c in RECTANGLE), *carried
    )
    reads = references.select(*key, "ref_path", *RECTANGLE, *(F.lit(None).cast(cells.schema[c].dataType).alias(f"_{c}") for c in keep))
    # What a package has comes to one task and one after the other; a task goes through many packages.
    together = formulas.unionByName(reads).repartition("package").sortWithinPartitions("package")
    types = [(c, cells.schema[c].dataType) for c in key]
    types += [("level", IntegerType()), ("in_cycle", BooleanType()), ("is_large", BooleanType())]
    given = StructType([StructField(*c) for c in types + [(c, cells.schema[c].dataType) for c in keep]])
    arrow = to_arrow_schema(given)
    found = staged(together.mapInArrow(lambda batches: _ordered_packages(batches, local_links, arrow), given), "levels")
    large = found.filter("is_large").select("package")
    found = found.filter("not is_large").drop("is_large")
    if large.isEmpty():
        return found
    mine = cells.filter("formula is not null").join(large, "package", "left_semi")
    return found.unionByName(_by_links(mine, references.join(large, "package", "left_semi").distinct(), local_links, keep))


def _by_links(cells: DataFrame, references: DataFrame, local_links: int, keep: tuple[str, ...]) -> DataFrame:
    """`formula_levels` of packages with many links."""
    spark = cells.sparkSession
    formulas = cells.select("package", "path", "ord", F.concat_ws(":", F.lit("c"), "path", "ord").alias("node"), *keep)
    with Scratch(spark) as scratch:
        links = scratch.staged(formula_links(cells, references), "links")
        counts = links.groupBy("package").agg(F.count(F.lit(1)).alias("n"))
        large = scratch.staged(counts.filter(F.col("n") > local_links).select("package"), "large")
        small = links.join(large, "package", "left_anti")
        # The links of a package come to one task and one after the other; a task goes through many packages.
        together = small.select("package", "before", "after").repartition("package").sortWithinPartitions("package")
        levels = together.mapInArrow(_level_batches, "package string, node string, level int")
        levels = [scratch.staged(levels, "levels")]
        if not large.isEmpty():
            levels += _peeled(links.join(large, "package", "left_semi"), scratch)
        known = levels[0]
        for more in levels[1:]:
            known = known.unionByName(more)
        waits = links.select("package", F.col("after").alias("node")).filter(F.col("node").startswith("c")).distinct()
        found = (
            formulas.join(known, ["package", "node"], "left")
            .join(waits.withColumn("waits", F.lit(True)), ["package", "node"], "left")
            .select(
                "package",
                "path",
                "ord",
                # Formulas in no link read no formula and are read by none.
                F.coalesce("level", F.when(F.col("waits").isNull(), 1)).alias("level"),
                (F.col("level").isNull() & F.col("waits").isNotNull()).alias("in_cycle"),
                *keep,
            )
        )
        return staged(found, "levels")


def _peeled(links: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables (package, node, level) of formulas, a level each."""
    is_cell = F.col("before").startswith("c")
    level, found = 0, []
    left = scratch.staged(links, "left")
    first = left.filter(is_cell).select("package", F.col("before").alias("node"))
    first = first.unionByName(left.filter(~is_cell).select("package", F.col("after").alias("node"))).distinct()
    waiting = scratch.staged(first, "waiting")
    while True:
        level += 1
        shut = left.filter(is_cell).select("package", F.col("after").alias("range")).distinct()
        read = left.filter(~is_cell).select("package", F.col("before").alias("range"), F.col("after").alias("node"))
        stuck = read.join(shut, ["package", "range"], "left_semi").select("package", "node").distinct()
        free = scratch.staged(waiting.join(stuck, ["package", "node"], "left_anti"), "free")
        if free.isEmpty():
            return found
        found.append(free.withColumn("level", F.lit(level)))
        waiting = scratch.staged(waiting.join(free, ["package", "node"], "left_anti"), "waiting")
        gone = left.filter(is_cell).join(free.withColumnRenamed("node", "before"), ["package", "before"], "left_anti")
        rest = left.filter(~is_cell).join(free.withColumnRenamed("node", "after"), ["package", "after"], "left_anti")
        left = scratch.staged(gone.unionByName(rest), "left")
