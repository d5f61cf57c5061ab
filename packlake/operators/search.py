"""Path search and content search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlake.functions.text import ascii_lower
from packlake.limits import DEFAULT, Limits, bound


def search_paths(parts: DataFrame, query: str) -> DataFrame:
    """Parts whose absolute path contains `query` (ASCII case ignored), ranked by path.

    Rank 0 is the selected match. `parts` is an index: at most 100,000 parts per package, so
    the rank has a bounded group.
    """
    w = Window.partitionBy("package").orderBy("path")
    hits = parts.select("package", "path").filter(
        F.contains(ascii_lower("path"), ascii_lower(F.lit(query))) & F.lit(query != "")
    )
    return hits.withColumn("rank", F.row_number().over(w) - 1)


def search_content(
    parts: DataFrame, needles: list[str], limits: Limits = DEFAULT
) -> DataFrame:
    """Parts `(package, path, kind, size, content)` holding a needle, byte for byte.

    All needles are tested in one pass over each content, in place: bytes are never shuffled,
    only `(package, needle, path)` is. With `limits.search_hits`, the first paths per package and
    needle are kept, with the cap applied before the shuffle too. A needle is searched whole; one
    longer than `limits.search_chars`, where that is set, is an error.
    """
    usable = [n for n in needles if n]
    if too_long := [n for n in usable if len(n) > bound(limits.search_chars)]:
        raise ValueError(f"needle of {len(too_long[0])} characters; limit is {limits.search_chars}")
    if not usable:
        return parts.select("package", F.lit("").alias("needle"), "path").limit(0)
    content = F.col("content").cast("binary")
    readable = (
        (F.col("kind") != "Directory")
        & (F.col("size") <= bound(limits.entry_bytes))
        & F.col("content").isNotNull()
    )
    tests = [
        F.when(F.contains(content, F.lit(n).cast("binary")), F.lit(n)) for n in dict.fromkeys(usable)
    ]
    found = parts.filter(readable).select(
        "package", "path", F.explode(F.array_compact(F.array(*tests))).alias("needle")
    )
    if limits.search_hits is None:
        return found.select("package", "needle", "path")
    w = Window.partitionBy("package", "needle").orderBy("path")
    return (
        found.withColumn("_rank", F.row_number().over(w))
        .filter(F.col("_rank") <= limits.search_hits)
        .select("package", "needle", "path")
    )
