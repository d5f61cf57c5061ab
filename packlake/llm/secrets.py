"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds, for each pair
of a blob and a rule version scanned so far, the spans found. A run scans only the pairs the ledger lacks,
each blob once however many versions have that content, adds them to the ledger, and joins the spans of
all current rule versions back to all paths. Raising a rule's version makes it scan all blobs again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.session import shared_dir, staged


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    flags: int = 0
    group: int = 0  # whose length counts
    least: int = 1


# Patterns and lengths, in the order of the kinds.
RULES = (
    Rule(
        "assign",
        1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII,
        2,
        8,
    ),
    # All characters of these two count, so asking for the length at once finds the same.
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 0, 32),
)
#: Rules beyond these: the head of a private key with what follows of it, a bearer token, and the password of
#: a user in an address.
MORE_RULES = (
    Rule("key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
    Rule("bearer", 1, r"\b[Bb]earer\x20+([A-Za-z0-9+/_.~-]+=*)", 0, 1, 20),
    Rule("address", 1, r"\b[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,100}:([^\s/@]{3,100})@", 0, 1, 3),
)
ALL_RULES = RULES + MORE_RULES

LEDGER = "blob binary, kind string, version int, starts array<long>, ends array<long>"
#: Rows of (path, blob, kinds) up to which a table is sent to all executors: some 100 MB.
BROADCAST_ROWS = 1_000_000


def find(pattern: re.Pattern, rule: Rule, text: str) -> tuple[list[int], list[int]]:
    found = [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [a for a, _ in found], [b for _, b in found]


def scan(contents: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of (blob, kinds, content)."""

    def run(batches):
        compiled = {r.kind: (re.compile(r.pattern, r.flags), r) for r in rules}
        for batch in batches:
            out = []
            for blob, kinds, text in zip(*(batch.column(c).to_pylist() for c in ("blob", "kinds", "content")), strict=True):
                for kind in kinds:
                    pattern, rule = compiled[kind]
                    out.append((blob, kind, rule.version, *find(pattern, rule, text or "")))
            blob, kind, version, starts, ends = zip(*out, strict=True) if out else ((),) * 5
            numbers = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(blob, pa.binary()), pa.array(kind, pa.string()), pa.array(version, pa.int32()), pa.array(starts, numbers), pa.array(ends, numbers)],
                ["blob", "kind", "version", "starts", "ends"],
            )

    return contents.select("blob", "kinds", "content").mapInArrow(run, LEDGER)


def read_ledger(spark, folder: str | None) -> DataFrame:
    if folder is None:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(folder)


def update(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(addressed versions, new ledger rows) for `versions` (path, content); `ledger` is its folder or None.

    The new rows are written to a folder of their own, so a run that fails leaves the ledger as it was; the
    caller appends them. A null content is the empty one. Paths may repeat or be null.
    """
    spark = versions.sparkSession
    address = F.unhex(F.sha2(F.coalesce(F.col("content"), F.lit("")).cast("binary"), 256)).alias("blob")
    content = versions.select("path", address, F.coalesce("content", F.lit("")).alias("content"))
    addressed = staged(content.select("path", "blob"), "versions")
    every = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    # The row of a blob with the smallest path holds it for the scan.
    blobs = addressed.groupBy("blob").agg(F.min("path").alias("path"))
    pairs = blobs.select("path", "blob", F.explode(every).alias("rule")).select("path", "blob", "rule.*")
    seen = read_ledger(spark, ledger).select("blob", "kind", "version").distinct() if ledger else None
    unseen = pairs.join(seen, ["blob", "kind", "version"], "left_anti") if seen is not None else pairs
    # One kind for each rule at most.
    todo = staged(unseen.groupBy("path", "blob").agg(F.collect_list("kind").alias("kinds")), "todo")
    same = [F.col("path").eqNullSafe(F.col("its_path")), F.col("blob") == F.col("its_blob")]
    renamed = lambda df: df.withColumnsRenamed({"path": "its_path", "blob": "its_blob"})
    if todo.count() <= BROADCAST_ROWS:
        wanted = content.join(F.broadcast(renamed(todo)), same)
    else:
        # Most is new: name the rows that are not scanned by all rules instead.
        odd = addressed.join(
            renamed(todo).withColumnRenamed("kinds", "own"), same, "left"
        ).select("path", "blob", F.coalesce("own", F.array().cast("array<string>")).alias("kinds"))
        odd = staged(renamed(odd.where(F.size("kinds") < len(rules)).distinct()), "seen")
        odd = F.broadcast(odd) if odd.count() <= BROADCAST_ROWS else odd
        default = F.array(*[F.lit(r.kind) for r in rules])
        wanted = content.join(odd, same, "left").withColumn("kinds", F.coalesce("kinds", default)).where(F.size("kinds") > 0)
    fresh = shared_dir(spark, "ledger")
    # Repeated rows of the holding path are scanned alike; one of them counts.
    scan(wanted, rules).dropDuplicates(["blob", "kind", "version"]).write.parquet(fresh)
    return addressed, spark.read.schema(LEDGER).parquet(fresh)


def findings(addressed: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, found) of all versions; `found` has (kind, start, end) by start, then order of the kinds.

    Only the current version of each rule counts. A version without findings has an empty list.
    """
    order = {r.kind: k for k, r in enumerate(rules)}
    current = [r.kind for r in rules], [r.version for r in rules]
    wanted = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version")) for k, v in zip(*current)])
    number = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("kind"))
    spans = F.transform(
        F.arrays_zip("starts", "ends"),
        lambda s: F.struct(s["starts"].alias("start"), number.alias("number"), s["ends"].alias("end"), F.col("kind").alias("kind")),
    )
    kept = ledger.where((F.size("starts") > 0) & F.array_contains(wanted, F.struct("kind", "version")))
    by_blob = (
        kept.dropDuplicates(["blob", "kind", "version"])
        .select("blob", spans.alias("spans"))
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))  # a list for each rule at most
    )
    simple = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    return addressed.join(by_blob, "blob", "left").select("path", "blob", F.coalesce(simple, none).alias("found"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with all its columns, each span of a finding in `text` replaced by `mark`.

    Overlapping spans are replaced together; a text without findings, or null, stays as it is. A column
    `n_chars`, where there is one, gets the new length of the texts that changed.
    """
    addressed, ledger = update(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")), rules=ALL_RULES)
    spans = staged(findings(addressed, ledger, ALL_RULES).where(F.size("found") > 0).distinct(), "findings")
    size = spans.count()
    spans = spans.toDF("_secret_path", "_secret_blob", "_secret_spans")
    spans = F.broadcast(spans) if size <= BROADCAST_ROWS else spans
    blob = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    same = [F.col("doc_id").eqNullSafe(F.col("_secret_path")), blob == F.col("_secret_blob")]

    def part(start, end):
        return F.substring("text", start.cast("int") + 1, (end - start).cast("int"))

    done = F.aggregate(
        "_secret_spans",
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda done, s: F.struct(
            F.when(s["start"] < done["at"], done["text"])
            .otherwise(F.concat(done["text"], part(done["at"], s["start"]), F.lit(mark)))
            .alias("text"),
            F.greatest(done["at"], s["end"]).alias("at"),
        ),
    )
    changed = F.concat(done["text"], part(done["at"], F.length("text").cast("long")))
    found = F.col("_secret_spans").isNotNull()
    joined = docs.join(spans, same, "left")
    columns = {"text": F.when(found, changed).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(found, F.length(changed).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])
