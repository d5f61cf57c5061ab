"""Cell references as rectangles, and joins of cells with rectangles that contain them.

Rectangles are cut at a grid whose tiles are about as large as they are, rows and columns apart, so each
lies in at most four tiles; a cell looks at its tile of each size that occurs. So the join is one of equal
keys and an exact test, with neither pairs of all cells and rectangles nor a bound on a rectangle's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.functions.xml import is_element, xml_attr
from packlake.operators.shred import found_rows, shred_xml

# The last row and column of a worksheet.
MAX_ROW, MAX_COLUMN = 1_048_576, 16_384
#: Tile heights and widths are powers of this one.
STEP = 8
RECTANGLE = ["top", "first_column", "bottom", "last_column"]
_REFERENCE = r"\A\s*(?:\$?([A-Za-z]{1,3}))?(?:\$?([0-9]{1,7}))?(?::(?:\$?([A-Za-z]{1,3}))?(?:\$?([0-9]{1,7}))?)?\s*\z"


def column_number(letters: Column) -> Column:
    """1 for A, 27 for AA; null for no letters."""
    codes = F.transform(F.split(F.upper(letters), ""), lambda c: F.ascii(c) - 64)
    return F.when(letters != "", F.aggregate(codes, F.lit(0), lambda a, c: a * 26 + c))


def rectangle(reference: Column | str) -> Column:
    """`A1`, `$B$2:D9`, `A:C` or `3:5` as a struct (top, first_column, bottom, last_column); else null.

    Corners may come in any order. A reference beyond the last row or column is none.
    """
    reference = F.col(reference) if isinstance(reference, str) else reference
    pieces = F.struct(
        *(F.regexp_extract(reference, _REFERENCE, k).alias(f"g{k}") for k in (1, 2, 3, 4)),
        F.contains(reference, F.lit(":")).alias("pair"),
    )

    def numbers(g: Column) -> Column:
        def number(digits: Column) -> Column:
            return F.nullif(digits, F.lit("")).cast("int")

        return F.struct(
            g["pair"].alias("pair"),
            column_number(g["g1"]).alias("c1"),
            number(g["g2"]).alias("r1"),
            F.when(g["pair"], column_number(g["g3"])).otherwise(column_number(g["g1"])).alias("c2"),
            F.when(g["pair"], number(g["g4"])).otherwise(number(g["g2"])).alias("r2"),
        )

    def corners(n: Column) -> Column:
        c1, r1, c2, r2 = n["c1"], n["r1"], n["c2"], n["r2"]
        has_columns, has_rows = c1.isNotNull() & c2.isNotNull(), r1.isNotNull() & r2.isNotNull()
        # A whole column has no rows at either end, a whole row no columns.
        columns = n["pair"] & has_columns & r1.isNull() & r2.isNull()
        lines = n["pair"] & has_rows & c1.isNull() & c2.isNull()
        top = F.when(columns, 1).otherwise(F.least(r1, r2))
        bottom = F.when(columns, MAX_ROW).otherwise(F.greatest(r1, r2))
        first = F.when(lines, 1).otherwise(F.least(c1, c2))
        last = F.when(lines, MAX_COLUMN).otherwise(F.greatest(c1, c2))
        fits = (top >= 1) & (bottom <= MAX_ROW) & (last <= MAX_COLUMN)
        return F.when(
            (columns | lines | has_columns & has_rows) & fits,
            F.struct(
                top.cast("int").alias("top"),
                first.cast("int").alias("first_column"),
                bottom.cast("int").alias("bottom"),
                last.cast("int").alias("last_column"),
            ),
        )

    return once(once(pieces, numbers), corners)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def placed(rows: DataFrame, reference: str, outer: bool = False) -> DataFrame:
    """Adds the columns RECTANGLE of a column of references, by the rules of `rectangle`; rows without one are left
    out, or have nulls if `outer`.

    In steps of plain expressions: the pieces of a reference are columns, computed once, and the generator keeps
    the test from being pushed below them and computed again.
    """
    ref, pair = F.col(reference), F.coalesce(F.contains(reference, F.lit(":")), F.lit(False))

    def piece(k: int) -> Column:
        return F.nullif(F.regexp_extract(ref, _REFERENCE, k), F.lit(""))

    pieces = rows.select(
        "*",
        pair.alias("_pair"),
        F.upper(piece(1)).alias("_g1"),
        piece(2).cast("int").alias("_r1"),
        F.when(pair, F.upper(piece(3))).alias("_g3"),
        F.when(pair, piece(4).cast("int")).alias("_r4"),
    )

    def number(letters: str) -> Column:
        """Of one to three capital letters."""
        code = [F.ascii(F.substring(letters, k, 1)) - 64 for k in (1, 2, 3)]
        return (
            F.when(F.length(letters) == 1, code[0])
            .when(F.length(letters) == 2, code[0] * 26 + code[1])
            .when(F.length(letters) == 3, code[0] * 676 + code[1] * 26 + code[2])
        )

    c1, r1, is_pair = F.col("_c1"), F.col("_r1"), F.col("_pair")
    c2, r2 = F.when(is_pair, F.col("_c3")).otherwise(c1), F.when(is_pair, F.col("_r4")).otherwise(r1)
    has_columns, has_rows = c1.isNotNull() & c2.isNotNull(), r1.isNotNull() & r2.isNotNull()
    columns = is_pair & has_columns & r1.isNull() & r2.isNull()
    lines = is_pair & has_rows & c1.isNull() & c2.isNull()
    corners = F.struct(
        F.when(columns, 1).otherwise(F.least(r1, r2)).alias("top"),
        F.when(lines, 1).otherwise(F.least(c1, c2)).alias("first_column"),
        F.when(columns, MAX_ROW).otherwise(F.greatest(r1, r2)).alias("bottom"),
        F.when(lines, MAX_COLUMN).otherwise(F.greatest(c1, c2)).alias("last_column"),
    )
    numbered = pieces.select("*", number("_g1").alias("_c1"), number("_g3").alias("_c3"))
    # Whether the corners are there and fit; `least` and `greatest` skip nulls.
    rows_fit = columns | (has_rows & (F.least(r1, r2) >= 1) & (F.greatest(r1, r2) <= MAX_ROW))
    columns_fit = lines | (has_columns & (F.greatest(c1, c2) <= MAX_COLUMN))
    names_one = rows_fit & columns_fit
    each = F.inline_outer if outer else F.inline
    return numbered.select(*rows.columns, each(F.when(names_one, F.array(corners))))


def _tile(extent: Column) -> Column:
    """The least power of STEP that is not below `extent`."""
    power = 1
    size = F.when(extent <= power, power)
    while power < MAX_ROW:
        power *= STEP
        size = size.when(extent <= power, power)
    return size


def contained(points: DataFrame, rectangles: DataFrame, keys: list[str]) -> DataFrame:
    """Each point `(…keys, row_no, column_no)` with each rectangle `(…keys, …RECTANGLE)` it lies in.

    Points and rectangles keep their other columns. Points in no rectangle give no row. A rectangle's tiles
    are spread over tasks; a tile that very many points share is split by the adaptive skew join.
    """
    heights, widths = F.col("bottom") - F.col("top") + 1, F.col("last_column") - F.col("first_column") + 1
    sized = rectangles.withColumn("tile_h", _tile(heights)).withColumn("tile_w", _tile(widths))

    def span(low: str, high: str, size: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(low) - 1) / F.col(size)), F.floor((F.col(high) - 1) / F.col(size))))

    tiled = sized.withColumn("tile_r", span("top", "bottom", "tile_h")).withColumn(
        "tile_c", span("first_column", "last_column", "tile_w")
    )
    # The sizes that occur, at most the square of the number of powers.
    sizes = sorted(tuple(r) for r in sized.select("tile_h", "tile_w").distinct().collect())
    if not sizes:
        sizes = [(1, 1)]
    looks = F.array(
        *(
            F.struct(
                F.lit(h).alias("tile_h"),
                F.lit(w).alias("tile_w"),
                F.floor((F.col("row_no") - 1) / h).alias("tile_r"),
                F.floor((F.col("column_no") - 1) / w).alias("tile_c"),
            )
            for h, w in sizes
        )
    )
    tiles = ["tile_h", "tile_w", "tile_r", "tile_c"]
    looking = points.select("*", F.inline(looks))
    inside = F.col("row_no").between(F.col("top"), F.col("bottom")) & F.col("column_no").between(
        F.col("first_column"), F.col("last_column")
    )
    return looking.join(tiled, [*keys, *tiles]).filter(inside).drop(*tiles)


def positioned(cells: DataFrame, reference: str = "reference") -> DataFrame:
    """Adds `row_no` and `column_no`; cells whose reference names no single cell are left out."""
    at = placed(cells, reference)
    single = (F.col("top") == F.col("bottom")) & (F.col("first_column") == F.col("last_column"))
    return at.filter(single).select(*cells.columns, F.col("top").alias("row_no"), F.col("first_column").alias("column_no"))


RANGE_NAMES = ["mergeCell"]


def range_tokens(contents: DataFrame, more: tuple[str, ...] = (), cells: str = "cells") -> DataFrame:
    """Tokens of merged ranges, cells and defined names, for the operators below; and of elements named in `more`.

    `cells` may be `formulas`: of the cells those with a formula alone.
    """
    return shred_xml(contents, names=[*RANGE_NAMES, *more], with_text=False, folds=(cells, "names"))


def merged_ranges(events: DataFrame) -> DataFrame:
    """`(package, path, ord, ref, …RECTANGLE)`: the merged ranges of worksheets, of `range_tokens`.

    References that name no rectangle are left out; repeated ones stay.
    """
    merges = events.filter(is_element("mergeCell", "Start", "Empty")).select(
        "package", "path", F.col("seq").alias("ord"), xml_attr("attrs", "ref").alias("ref")
    )
    return placed(merges, "ref")


def merged_anchors(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells with the merged range they lie in: `ref`, its first cell `anchor`, and `is_anchor`.

    Cells outside all ranges have nulls. Ranges of one sheet may not overlap; where they do, the one that
    comes first in the sheet counts. A cell whose reference names no cell is in no range.
    """
    letters = column_letters("first_column")
    found = (
        contained(positioned(cells.select("package", "path", "ord", "reference")), merges.withColumnRenamed("ord", "range_ord"), ["package", "path"])
        .groupBy("package", "path", "ord")
        .agg(
            F.min_by(
                F.struct(
                    "ref",
                    F.concat(letters, F.col("top")).alias("anchor"),
                    ((F.col("row_no") == F.col("top")) & (F.col("column_no") == F.col("first_column"))).alias("is_anchor"),
                ),
                "range_ord",
            ).alias("m")
        )
        .select("package", "path", "ord", "m.*")
    )
    return cells.join(found, ["package", "path", "ord"], "left")


def column_letters(number: Column | str) -> Column:
    """A for 1, AA for 27; up to three letters."""
    n = (F.col(number) if isinstance(number, str) else number) - 1

    def letter(k: Column) -> Column:
        return F.char((F.pmod(k, F.lit(26)) + 65).cast("long"))

    second, third = F.floor((n - 26) / 26), F.floor((n - 702) / 676)
    return F.concat(F.when(n >= 702, letter(third)).otherwise(""), F.when(n >= 26, letter(second)).otherwise(""), letter(n))


def defined_names(events: DataFrame) -> DataFrame:
    """`(package, ord, name, local_sheet, sheet, ref, …RECTANGLE)`: names for one range of a sheet each.

    Of `range_tokens`. A name of several ranges has a row each; of anything else (constants, formulas,
    other files) none. `local_sheet` is the position of the sheet that a name is limited to.
    """
    quoted = r"(?:'((?:[^']|'')+)'|([^'!,\[\]()+*/ ]+))!(\$?[A-Za-z]{0,3}\$?[0-9]{0,7}(?::\$?[A-Za-z]{0,3}\$?[0-9]{0,7})?)"
    area = rf"\A{quoted}\z"
    areas = (
        found_rows(events, "Name")
        .select(
            "package",
            F.col("seq").alias("ord"),
            xml_attr("attrs", "name").alias("name"),
            xml_attr("attrs", "localSheetId").cast("int").alias("local_sheet"),
            F.explode(F.regexp_extract_all("text", F.lit(quoted), 0)).alias("area"),
            "text",
        )
        .filter(F.regexp_replace("text", quoted, "").rlike(r"\A,*\z"))
        .select(
            "package",
            "ord",
            "name",
            "local_sheet",
            F.concat(F.replace(F.regexp_extract("area", area, 1), F.lit("''"), F.lit("'")), F.regexp_extract("area", area, 2)).alias("sheet"),
            F.regexp_extract("area", area, 3).alias("ref"),
        )
    )
    return placed(areas, "ref")


def named_cells(cells: DataFrame, names: DataFrame, sheets: DataFrame) -> DataFrame:
    """`(package, path, ord, name, ref)`: cells that lie in a named range; sheets link names to parts."""
    where = names.join(sheets.select("package", F.col("name").alias("sheet"), "path"), ["package", "sheet"]).drop("ord")
    points = positioned(cells.select("package", "path", "ord", "reference"))
    return contained(points, where, ["package", "path"]).select("package", "path", "ord", "name", "ref")
