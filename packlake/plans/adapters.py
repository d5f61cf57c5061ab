"""Plain tables seen as package data, so every operator can run on parquet.

Each adapter is row-local (one table row makes its own entries, parts or package), so its work
grows with the table and no key can pile up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake.functions import paths as P
from packlake.operators import index as I
from packlake.session import staged


class Tables:
    """The given tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A small table over all cores, for adapters that make packages of the rows of one file.

    Tables of as many files as there are cores stay as they are. With `keys`, columns that tell rows apart,
    rows are dealt by their hash; dealing them in turns costs a sort of all of them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if len(df.inputFiles()) < cores else df


def escaped(sql: str) -> str:
    """SQL text that XML-escapes the value of `sql`."""
    return f"replace(replace(replace({sql}, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"


# Paths: pages as archive entries ------------------------------------------------------------

PAGE_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"
PAGE_PATH = "regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1)"
ENTRY_NAMES = """array(
    p,
    concat('word/./', p, '.XML'),
    concat('/media/', page_id, '.PnG'),
    concat('a/../', p, '/'),
    concat(p, chr(92), 'data', chr(92), 'item.bin'),
    concat('_rels/', p, '.rels'),
    CASE WHEN page_id % 10 = 0 THEN concat(repeat('d/', 64), page_id)
         ELSE concat('//x///', p, '.json') END,
    CASE WHEN page_id % 3 = 0 THEN concat('./', p) ELSE './' END,
    concat('custom.', page_id % 7))"""


def page_base(t: Tables) -> DataFrame:
    return t.pages.selectExpr(
        "page_id", f"{PAGE_HOST} AS package", f"{PAGE_PATH} AS p", "octet_length(html) AS n"
    )


def page_entries(t: Tables) -> DataFrame:
    """Package = host; nine archive entries per page, most with dirty names."""
    return (
        page_base(t)
        .select("page_id", "package", "n", F.posexplode(F.expr(ENTRY_NAMES)).alias("k", "archive_name"))
        .select(
            "package",
            (F.col("page_id") * 16 + F.col("k")).alias("ord"),
            "archive_name",
            (F.col("archive_name").endswith("/") | F.col("archive_name").endswith("\\")).alias("is_dir"),
            (F.col("n") + F.col("k")).cast("bigint").alias("size"),
            F.expr("(n + k) div 3").cast("bigint").alias("compressed_size"),
        )
    )


def page_type_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Declared content types of the page packages; the last declaration wins."""
    declared = """map_entries(map(
        'xml', 'application/xml',
        'png', 'image/png',
        'bin', if(page_id % 2 = 0, 'application/x-bin', 'IMAGE/x-raw'),
        '1', 'text/xml ; charset=utf-8',
        '2', if(page_id % 3 = 0, 'Application/VND.a+XML', 'text/plain')))"""
    defaults = (
        page_base(t)
        .select("package", "page_id", F.expr(f"inline({declared})").alias("extension", "content_type"))
        .groupBy("package", "extension")
        .agg(F.max_by("content_type", "page_id").alias("content_type"))
    )
    overrides = (
        page_base(t)
        .select(
            "package",
            "page_id",
            F.concat(F.lit("/"), P.normalize_path("p")).alias("path"),
            F.expr(
                "CASE page_id % 4 WHEN 0 THEN 'application/vnd.x+xml' "
                "WHEN 1 THEN 'image/svg' ELSE 'text/plain' END"
            ).alias("content_type"),
        )
        .groupBy("package", "path")
        .agg(F.max_by("content_type", "page_id").alias("content_type"))
    )
    return defaults, overrides


def page_parts(t: Tables) -> DataFrame:
    """The index of the page packages, limits applied."""
    named = I.dedupe_first_wins(I.accept_packages(page_entries(t)))
    return I.refine_kind(I.resolve_content_type(named, *page_type_tables(t)))


# Totals: order lines as archive entries -----------------------------------------------------


def order_entries(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(
        "concat('order-', l_orderkey) AS package",
        "l_linenumber AS ord",
        "concat('line/', l_linenumber) AS archive_name",
        "false AS is_dir",
        "CAST(l_quantity AS bigint) * 1000 AS size",
        "CAST(l_quantity AS bigint) * 10 AS compressed_size",
    )


# Graph: foreign keys as relationships -------------------------------------------------------



def _sales(key: str) -> str:
    """One package for all rows that have a key."""
    return f"if({key} IS NULL, NULL, 'sales')"



def graph_parts(t: Tables) -> DataFrame:
    """One part per row of the key tables."""

    def rows(df: DataFrame, name: str, key: str, label: str) -> DataFrame:
        return df.selectExpr(
            f"{_sales(key)} AS package",
            f"concat('/{name}/', {key}) AS path",
            f"concat(if({key} % 5 = 0, './', ''), '{name}/', {key}) AS archive_name",
            f"if({key} % 3 = 0, NULL, 'application/vnd.{name}+xml') AS content_type",
            f"CAST(octet_length({label}) AS bigint) AS size",
            f"CAST(octet_length({label}) div 2 AS bigint) AS compressed_size",
            f"CASE {key} % 3 WHEN 0 THEN 'Binary' WHEN 1 THEN 'Xml' ELSE 'Image' END AS kind",
        )

    return (
        rows(t.region, "region", "r_regionkey", "r_name")
        .unionByName(rows(t.nation, "nation", "n_nationkey", "n_name"))
        .unionByName(rows(t.customer, "customer", "c_custkey", "c_name"))
        .unionByName(rows(t.supplier, "supplier", "s_suppkey", "s_name"))
        .unionByName(rows(t.part, "part", "p_partkey", "p_name"))
        .unionByName(rows(spread(t.orders, "o_orderkey", "o_orderpriority"), "orders", "o_orderkey", "o_orderpriority"))
    )


def graph_relationships(t: Tables) -> DataFrame:
    """Foreign keys as links; those of the seventh order lines point nowhere."""

    def rows(df, source, id_, ord_, kind, target, external="false"):
        external = F.expr(external)
        return df.select(
            F.expr(_sales(df.columns[0])).alias("package"),
            F.expr(source).alias("source"),
            F.expr(ord_).cast("bigint").alias("rel_ord"),
            F.expr(id_).alias("id"),
            F.lit(f"http://example.org/rel/{kind}").alias("relationship_type"),
            F.expr(target).alias("target"),
            external.alias("external"),
        )

    links = (
        rows(t.nation, "concat('/nation/', n_nationkey)", "'r1'", "1", "region", "concat('../region/', n_regionkey)")
        .unionByName(
            rows(t.customer, "concat('/customer/', c_custkey)", "'r1'", "1", "nation", "concat('/nation/', c_nationkey)")
        )
        .unionByName(
            rows(t.supplier, "concat('/supplier/', s_suppkey)", "'r1'", "1", "nation", "concat('.././nation//', s_nationkey)")
        )
        .unionByName(
            rows(spread(t.orders, "o_orderkey", "o_custkey"), "concat('/orders/', o_orderkey)", "'r1'", "1", "customer", "concat('../customer/', o_custkey)", "o_orderkey % 7 = 0")
        )
        .unionByName(
            rows(
                spread(t.lineitem, "l_orderkey", "l_linenumber"),
                "concat('/orders/', l_orderkey)",
                "concat('p', l_linenumber)",
                "l_partkey * 10 + l_linenumber",
                "image",
                "concat('x/../../part/', if(l_linenumber = 7, 'lost/', ''), l_partkey)",
                "(l_orderkey + l_linenumber) % 7 = 0",
            )
        )
    )
    return links.withColumn(
        "resolved_target", F.when(~F.col("external"), P.resolve_target("source", "target"))
    ).withColumn(
        "target_mode", F.when(F.col("external"), "External").otherwise("Internal")
    ).drop("external")


def graph_diagnostics(t: Tables) -> DataFrame:
    return I.diagnostic(
        t.customer.filter("c_acctbal < 0").selectExpr(f"{_sales('c_custkey')} AS package", "c_custkey"),
        "Warning",
        "index",
        F.concat(F.lit("/customer/"), F.col("c_custkey")),
        F.lit("negative balance"),
    )


# Documents as parts -------------------------------------------------------------------------


def document_parts(t: Tables) -> DataFrame:
    """Package = source; a document is a part whose extension, type and bytes vary by id."""
    extension = "element_at(array('txt','json','bin','xml','ttf','mp3','dat','PNG'), CAST(doc_id % 8 AS int) + 1)"
    return spread(t.documents).selectExpr(
        "source AS package",
        f"concat('/docs/', lang, '/', doc_id, '.', {extension}) AS path",
        f"concat('docs/', lang, '/', doc_id, '.', {extension}) AS archive_name",
        "element_at(array(NULL, 'application/json', 'application/vnd.ms-office.vbaProject', "
        "'text/xml; charset=utf-8', 'audio/x-test', NULL, NULL), CAST(doc_id % 7 AS int) + 1) AS content_type",
        "CAST(octet_length(text) AS bigint) AS size",
        "CAST(octet_length(text) div 2 AS bigint) AS compressed_size",
        "CASE WHEN doc_id % 9 = 0 THEN concat(X'FF00', CAST(text AS binary)) "
        "WHEN doc_id % 10 = 1 THEN CAST(concat(text, chr(7)) AS binary) "
        "WHEN doc_id % 11 = 0 THEN concat(X'EFBBBF', CAST(text AS binary)) "
        "ELSE CAST(text AS binary) END AS content",
        "'Binary' AS kind",
        "doc_id",
    )


def document_lines(t: Tables) -> DataFrame:
    """Each document as a report; every third line links its first word."""
    return t.documents.select(
        F.col("doc_id").cast("string").alias("package"),
        F.posexplode(F.split("text", "\n")).alias("line", "text"),
    ).withColumn(
        "target",
        F.expr("if(line % 3 = 0, nullif(regexp_extract(text, '^ ?([^ ]+)', 1), ''), NULL)"),
    )


# XML parts from page links ------------------------------------------------------------------

HREFS = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"
LINK_TARGET = "CASE WHEN i % 3 = 1 THEN concat('../', substring(h, 2)) ELSE h END"


def page_rels(t: Tables) -> DataFrame:
    """Package = page; one relationships part with the links of the page.

    Some parts are malformed and some have an element without target.
    """
    q = f"regexp_replace({PAGE_PATH}, '/+$', '')"
    element = (
        "concat('<r:Relationship Id=\"rId', i, '\" Type=\"http://example.org/rel/link', i % 2, '\" Target=\"', "
        f"{escaped(LINK_TARGET)}, '\"', if(i % 5 = 4, ' TargetMode=\"external\"', ''), '/>')"
    )
    return spread(t.pages).selectExpr("page_id", f"{q} AS q", f"{HREFS} AS hrefs").selectExpr(
        "concat('page-', page_id) AS package",
        "page_id AS ord",
        "CASE WHEN page_id % 19 = 0 THEN concat('/misc/', page_id, '.RELS') "
        "ELSE concat('/', if(contains(q, '/'), concat(regexp_extract(q, '^(.*)/', 1), '/'), ''), "
        "'_rels/', substring_index(q, '/', -1), '.rels') END AS path",
        "concat('<?xml version=\"1.0\"?><r:Relationships xmlns:r=\"urn:r\">', "
        f"array_join(transform(hrefs, (h, i) -> {element}), ''), "
        "CASE WHEN page_id % 17 = 0 THEN '<r:Relationship Id=\"x\" Type=\"y\" Target=\"\"/>' ELSE '' END, "
        "if(page_id % 13 = 0, '</r:Broken>', '</r:Relationships>')) AS content",
    ).withColumn("archive_name", F.substring("path", 2, 2**31 - 1))


def page_content_types(t: Tables) -> DataFrame:
    """Package = page; one content-types part: defaults by link order, an override per link."""
    override = (
        f"concat('<Override PartName=\"', {escaped('h')}, '\" ContentType=\"application/x-', i, '\"/>')"
    )
    default = "concat('<Default Extension=\"E', i % 3, '\" ContentType=\"text/t', i, '\"/>')"
    return spread(t.pages).selectExpr("page_id", f"{HREFS} AS hrefs").selectExpr(
        "concat('page-', page_id) AS package",
        "page_id AS ord",
        "'/[Content_Types].xml' AS path",
        "concat('<Types>', "
        f"array_join(transform(hrefs, (h, i) -> concat({default}, {override})), ''), "
        "'<Default Extension=\"lost\"/><Override PartName=\"/lost\"/>', "
        "CASE WHEN page_id % 13 = 0 THEN '</Broken>' WHEN page_id % 11 = 0 THEN '' ELSE '</Types>' END) AS content",
    )


# Packages with files ------------------------------------------------------------------------
# Each is `(package, files ARRAY<STRUCT<name, content>>)`, one package per table row.


def _file(name: str, content: str) -> str:
    return f"struct({name} AS name, {content} AS content)"


def _relationship(id_: str, kind: str, target: str) -> str:
    return (
        f"concat('<Relationship Id=\"', {id_}, '\" Type=\"http://example.org/rel/{kind}\" "
        f"Target=\"', {target}, '\"/>')"
    )


def _rels(*elements: str) -> str:
    return f"concat('<Relationships>', {', '.join(elements)}, '</Relationships>')"


def _each(values: str, body: str) -> str:
    """SQL text: `body` over (`x`, `i`) of an array, concatenated; `i` counts from 1."""
    return f"array_join(transform({values}, (x, j) -> {body.replace('{i}', '(j + 1)')}), '')"


TYPES_XML = (
    "'<Types><Default Extension=\"rels\" ContentType=\"application/vnd.openxmlformats-package.relationships+xml\"/>"
    "<Default Extension=\"xml\" ContentType=\"application/xml\"/>"
    "<Default Extension=\"dat\" ContentType=\"application/x-data+xml\"/></Types>'"
)


def _root_rels(main: str) -> str:
    return _rels(_relationship("'rId1'", "officeDocument", f"'{main}'"))


def deck_files(t: Tables) -> DataFrame:
    """Conversation turns as presentations: one slide per line, last line first.

    Slides whose number is a multiple of 4 have no title; odd slides of assistant turns have
    notes; slide n has n % 3 images. Every 29th package holds a slide that is no XML.
    """
    run = "concat('<a:r><a:t>', {v}, '</a:t></a:r>')"
    half = "CAST(length(x) div 2 AS int)"
    first = run.format(v=escaped(f"substring(x, 1, {half})"))
    second = run.format(v=escaped(f"substring(x, {half} + 1, length(x))"))
    shape = (
        "concat('<p:sp><p:nvPr><p:ph type=\"', if({i} % 4 = 0, 'body', if({i} % 2 = 0, 'ctrTitle', 'TITLE')), "
        f"'\"/></p:nvPr><a:p>', {first}, {second}, '</a:p></p:sp>')"
    )
    slide = (
        "concat('<p:sld xmlns:p=\"p\" xmlns:a=\"a\"><p:sp><a:t>noise</a:t></p:sp>', "
        f"{shape}, if(broken AND {{i}} = 1, '</p:lost>', '</p:sld>'))"
    )
    notes = "concat('<p:notes xmlns:p=\"p\"><t>Notes  on</t> <t>', " + escaped("x") + ", '</t></p:notes>')"
    images = (
        "array_join(transform(sequence(1, 2), n -> if(n <= {i} % 3, concat("
        "'<Relationship Id=\"img', n, '\" Type=\"http://example.org/rel/image\" Target=\"../media/i', n, '.png\"/>'"
        "), '')), '')"
    )
    note_link = (
        "if(noted AND {i} % 2 = 1, concat('<Relationship Id=\"n1\" Type=\"http://example.org/rel/notesSlide\" "
        "Target=\"../notesSlides/notesSlide', {i}, '.xml\"/>'), '')"
    )
    slide_rels = f"concat('<Relationships>', {images}, {note_link}, '</Relationships>')"
    id_list = "concat('<p:sldId id=\"', 255 + {i}, '\" r:id=\"rId', size(lines) - {i} + 1, '\"/>')"

    def many(name: str, content: str, keep: str = "true") -> str:
        entry = f"named_struct('name', {name}, 'content', {content})".replace("{i}", "(j + 1)")
        chosen = f"transform(lines, (x, j) -> {entry})"
        return f"filter({chosen}, (e, j) -> {keep.replace('{i}', '(j + 1)')})"

    presentation = (
        "concat('<p:presentation xmlns:p=\"p\" xmlns:r=\"r\"><p:sldIdLst><p:sldId r:id=\"lost\"/>', "
        f"{_each('lines', id_list)}, '</p:sldIdLst></p:presentation>')"
    )
    presentation_rels = _rels(
        _each("lines", _relationship("concat('rId', {i})", "slide", "concat('slides/slide', {i}, '.xml')"))
    )
    base = spread(t.conversations).selectExpr(
        "concat('c', conv_id, '-', turn) AS package",
        "split(text, '\\n') AS lines",
        "role = 'assistant' AS noted",
        "(conv_id + turn) % 29 = 0 AS broken",
    )
    fixed = ", ".join(
        [
            _file("'[Content_Types].xml'", TYPES_XML),
            _file("'_rels/.rels'", _root_rels("ppt/presentation.xml")),
            _file("'ppt/presentation.xml'", presentation),
            _file("'ppt/_rels/presentation.xml.rels'", presentation_rels),
        ]
    )
    return base.selectExpr(
        "package",
        f"concat(array({fixed}), "
        + many("concat('ppt/slides/slide', {i}, '.xml')", slide)
        + ", "
        + many("concat('ppt/slides/_rels/slide', {i}, '.xml.rels')", slide_rels)
        + ", "
        + many("concat('ppt/notesSlides/notesSlide', {i}, '.xml')", notes, "noted AND {i} % 2 = 1")
        + ") AS files",
    )


def word_files(t: Tables) -> DataFrame:
    """Documents as text documents: one paragraph per line.

    The first line is a level-1 heading, every fifth one a level-2 heading; every seventh has a
    style that is no heading. `doc_id % 3` images, one table if `doc_id % 4 = 0`.
    """
    style = (
        "CASE WHEN {i} = 1 THEN '<w:pPr><w:pStyle w:val=\"Heading1\"/></w:pPr>' "
        "WHEN {i} % 5 = 0 THEN '<w:pPr><w:pStyle w:val=\"Heading+2\"></w:pStyle></w:pPr>' "
        "WHEN {i} % 7 = 0 THEN '<w:pPr><w:pStyle w:val=\"HeadingX\"/></w:pPr>' ELSE '' END"
    )
    paragraph = (
        f"concat('<w:p>', {style}, '<w:r><w:t>', {escaped('x')}, "
        "'</w:t></w:r><w:instrText>skip</w:instrText></w:p>')"
    )
    document = (
        f"concat('<w:document xmlns:w=\"w\"><w:body><w:p/>', {_each('lines', paragraph)}, "
        "if(doc_id % 4 = 0, '<w:tbl/>', ''), '</w:body></w:document>')"
    )
    links = (
        "array_join(transform(sequence(1, 2), n -> if(n <= doc_id % 3, concat("
        "'<Relationship Id=\"img', n, '\" Type=\"http://example.org/rel/image\" TargetMode=\"External\" Target=\"http://x/', n, '\"/>'"
        "), '')), '')"
    )
    files = ", ".join(
        [
            _file("'[Content_Types].xml'", TYPES_XML),
            _file("'_rels/.rels'", _root_rels("word/document.xml")),
            _file("'word/document.xml'", document),
            _file("'word/_rels/document.xml.rels'", _rels(links)),
        ]
    )
    return spread(t.documents).selectExpr("doc_id", "split(text, '\\n') AS lines").selectExpr(
        "concat('d', doc_id) AS package", f"array({files}) AS files"
    )


def workbook_files(t: Tables) -> DataFrame:
    """Customers as workbooks: a `Main` sheet of typed cells, a `List` sheet of numbers, and for
    every fifth customer a sheet whose part is not there to be found."""
    cents = "CAST(round(c_acctbal * 100) AS bigint)"
    workbook = (
        "concat('<workbook xmlns:r=\"r\"><sheets><sheet name=\"Main\" r:id=\"rId1\"/>"
        "<sheet name=\"List &amp; more\" r:id=\"rId2\"/><sheet name=\"no id\"/>', "
        "if(c_custkey % 5 = 0, '<sheet name=\"Lost\" r:id=\"rId9\"/>', ''), '</sheets></workbook>')"
    )
    strings = (
        f"concat('<sst><si><t>', {escaped('c_name')}, '</t></si><si/><si><r><t>', "
        f"{escaped('c_mktsegment')}, '</t></r><r><t> &amp; co</t></r></si></sst>')"
    )
    main = (
        "concat('<worksheet><dimension ref=\"A1:G1\"/><sheetData><row>', "
        "'<c r=\"A1\" t=\"s\"><v>0</v></c><c r=\"B1\" t=\"s\"><v>1</v></c>', "
        f"'<c r=\"C1\"><v>', {cents}, '</v></c>', "
        f"'<c r=\"D1\"><f>C1*', c_nationkey, '</f><v>', {cents} * c_nationkey, '</v></c>', "
        f"'<c r=\"E1\" t=\"inlineStr\"><is><t>', {escaped('c_name')}, '</t></is></c>', "
        "'<c r=\"F1\" t=\"s\"><v>99</v></c><c r=\"G1\"/></row></sheetData></worksheet>')"
    )
    numbers = (
        "concat('<worksheet><sheetData>', array_join(transform(sequence(1, 18 + CAST(c_custkey % 6 AS int)), "
        "n -> concat('<c r=\"A', n, '\"><v>', n * c_custkey, '</v></c>')), ''), '</sheetData></worksheet>')"
    )
    files = ", ".join(
        [
            _file("'[Content_Types].xml'", TYPES_XML),
            _file("'_rels/.rels'", _root_rels("xl/workbook.xml")),
            _file("'xl/workbook.xml'", workbook),
            _file(
                "'xl/_rels/workbook.xml.rels'",
                _rels(
                    _relationship("'rId1'", "worksheet", "'worksheets/sheet1.xml'"),
                    _relationship("'rId2'", "worksheet", "'/xl/worksheets/sheet2.xml'"),
                ),
            ),
            _file("'xl/sharedStrings.xml'", strings),
            _file("'xl/worksheets/sheet1.xml'", main),
            _file("'xl/worksheets/sheet2.xml'", numbers),
        ]
    )
    return spread(t.customer).selectExpr("concat('w', c_custkey) AS package", f"array({files}) AS files")


# Workbooks with formulas, merged ranges and names -------------------------------------------


def ledger_files(t: Tables) -> DataFrame:
    """Customers as workbooks whose first sheet has `c_nationkey + 2` rows of formulas.

    Column B adds up column A row by row, column C sums up column B so far, E1 reads a defined name. Every
    fourth customer's D1 and D2 read each other; the others' read another sheet, and a text that looks like
    a range. Below the rows lie two merged ranges, one of them with cells in it.
    """
    n = "(c_nationkey + 2)"
    rows = (
        f"array_join(transform(sequence(1, {n}), i -> concat('<c r=\"A', i, '\"><v>', i * c_custkey, '</v></c>', "
        "'<c r=\"B', i, '\"><f>', if(i = 1, 'A1+1', concat('B', i - 1, '+A', i)), '</f></c>', "
        "'<c r=\"C', i, '\"><f>SUM($B$1:B', i, ')</f></c>')), '')"
    )
    looped = "concat('<c r=\"D1\"><f>D2*2</f></c><c r=\"D2\"><f>D1+$A$1</f></c>')"
    plain = (
        "concat('<c r=\"D1\"><f>LOG10(''List &amp; more''!A1)+[1]Other!B2</f></c>"
        "<c r=\"D2\"><f>\"A1:B2\"&amp;\"\"\"C1\"</f></c>')"
    )
    sheet = (
        f"concat('<worksheet><sheetData>', {rows}, if(c_custkey % 4 = 0, {looped}, {plain}), "
        "'<c r=\"E1\"><f>MAX(totals)*Rate</f></c><c r=\"F3\"><v>1</v></c>', "
        f"'<c r=\"A', {n} + 1, '\"><v>x</v></c><c r=\"B', {n} + 1, '\"><v>y</v></c></sheetData>', "
        f"'<mergeCells><mergeCell ref=\"A', {n} + 1, ':C', {n} + 2, '\"/><mergeCell ref=\"E2:F3\"/>"
        "<mergeCell ref=\"lost\"/></mergeCells></worksheet>')"
    )
    workbook = (
        "concat('<workbook xmlns:r=\"r\"><sheets><sheet name=\"Main\" r:id=\"rId1\"/>"
        "<sheet name=\"List &amp;amp; more\" r:id=\"rId2\"/></sheets><definedNames>"
        f"<definedName name=\"Totals\">Main!$B$1:$B$', {n}, '</definedName>"
        "<definedName name=\"Local\" localSheetId=\"0\">''List &amp;amp; more''!$A:$A</definedName>"
        "<definedName name=\"Rate\">0.2</definedName></definedNames></workbook>')"
    ).replace("&amp;amp;", "&amp;")
    lists = "'<worksheet><sheetData><c r=\"A1\"><v>1</v></c><c r=\"A2\"/><c r=\"B2\"><v>2</v></c></sheetData></worksheet>'"
    links = _rels(
        _relationship("'rId1'", "worksheet", "'worksheets/sheet1.xml'"),
        _relationship("'rId2'", "worksheet", "'worksheets/sheet2.xml'"),
    )
    files = ", ".join(
        [
            _file("'[Content_Types].xml'", TYPES_XML),
            _file("'xl/workbook.xml'", workbook),
            _file("'xl/_rels/workbook.xml.rels'", links),
            _file("'xl/worksheets/sheet1.xml'", sheet),
            _file("'xl/worksheets/sheet2.xml'", lists),
        ]
    )
    return spread(t.customer).selectExpr("concat('w', c_custkey) AS package", f"array({files}) AS files")


# Text documents with styles and links -------------------------------------------------------


def styled_files(t: Tables) -> DataFrame:
    """Documents as text documents whose headings are known by styles alone.

    Style S0 has the level `doc_id % 3`, S1 is based on it, and so on up to S`m` with `m = doc_id % 6`.
    Paragraphs use S`m`, a style of a loop, no style, or a level of their own, in turns.
    """
    styles = (
        "concat('<w:styles xmlns:w=\"w\"><w:style w:styleId=\"S0\"><w:name w:val=\"zero\"/><w:pPr><w:outlineLvl w:val=\"', "
        "doc_id % 3, '\"/></w:pPr></w:style>', array_join(transform(sequence(0, CAST(doc_id % 6 AS int)), m -> if(m = 0, '', concat("
        "'<w:style w:styleId=\"S', m, '\"><w:basedOn w:val=\"S', m - 1, '\"/></w:style>'))), ''), "
        "'<w:style w:styleId=\"Loop1\"><w:basedOn w:val=\"Loop2\"/></w:style>"
        "<w:style w:styleId=\"Loop2\"><w:basedOn w:val=\"Loop1\"/></w:style>"
        "<w:style w:styleId=\"Body\"><w:basedOn w:val=\"Lost\"/><w:pPr><w:outlineLvl w:val=\"9\"/></w:pPr></w:style></w:styles>')"
    )
    style = (
        "CASE {i} % 5 WHEN 0 THEN concat('<w:pPr><w:pStyle w:val=\"S', doc_id % 6, '\"/></w:pPr>') "
        "WHEN 1 THEN '<w:pPr><w:pStyle w:val=\"Loop1\"/></w:pPr>' "
        "WHEN 2 THEN '<w:pPr><w:pStyle w:val=\"Body\"/><w:outlineLvl w:val=\"1\"/></w:pPr>' "
        "WHEN 3 THEN '<w:pPr><w:pStyle w:val=\"Body\"/></w:pPr>' ELSE '' END"
    )
    paragraph = f"concat('<w:p>', {style}, '<w:r><w:t>', {escaped('x')}, '</w:t></w:r></w:p>')"
    document = f"concat('<w:document xmlns:w=\"w\"><w:body>', {_each('lines', paragraph)}, '</w:body></w:document>')"
    files = ", ".join([_file("'word/document.xml'", document), _file("'word/styles.xml'", styles)])
    return spread(t.documents).selectExpr("doc_id", "split(text, '\\n') AS lines").selectExpr(
        "concat('d', doc_id) AS package", f"array({files}) AS files"
    )


def linked_files(t: Tables) -> DataFrame:
    """Documents as text documents: odd lines are hyperlinks, even ones fields with a field inside.

    Hyperlinks with a number divisible by 3 have an anchor, the others a relationship; every fifth
    document ends within a field.
    """
    link = (
        "concat('<w:p><w:hyperlink ', if({i} % 3 = 0, concat('w:anchor=\"a', {i}, '\"'), concat('r:id=\"r', {i}, '\"')), "
        f"'><w:r><w:t>', {escaped('x')}, '</w:t></w:r></w:hyperlink></w:p>')"
    )
    mark = "<w:r><w:fldChar w:fldCharType=\"{}\"/></w:r>".format
    field = (
        f"concat('<w:p>{mark('begin')}<w:r><w:instrText> HYPERLINK </w:instrText></w:r>', "
        "'<w:r><w:instrText>\"http://y/', {i}, '\" </w:instrText></w:r>', "
        f"'{mark('separate')}<w:r><w:t>', {escaped('x')}, '</w:t></w:r>{mark('begin')}<w:r><w:instrText>PAGE</w:instrText></w:r>"
        f"{mark('separate')}<w:r><w:t>7</w:t></w:r>{mark('end')}</w:p><w:p>{mark('end')}</w:p>')"
    )
    paragraph = f"if({{i}} % 2 = 1, {link}, {field})"
    document = (
        f"concat('<w:document xmlns:w=\"w\" xmlns:r=\"r\"><w:body>', {_each('lines', paragraph)}, "
        f"if(doc_id % 5 = 0, '<w:p>{mark('begin')}<w:r><w:instrText>REF x</w:instrText></w:r></w:p>', ''), "
        "'</w:body></w:document>')"
    )
    element = (
        "concat('<Relationship Id=\"r', {i}, '\" Type=\"http://example.org/rel/hyperlink\" TargetMode=\"External\" "
        "Target=\"http://x/', doc_id, '/', {i}, '\"/>')"
    )
    files = ", ".join(
        [
            _file("'word/document.xml'", document),
            _file("'word/_rels/document.xml.rels'", _rels(_each("lines", element))),
        ]
    )
    return spread(t.documents).selectExpr("doc_id", "split(text, '\\n') AS lines").selectExpr(
        "concat('d', doc_id) AS package", f"array({files}) AS files"
    )


def themed_files(t: Tables) -> DataFrame:
    """Conversation turns as presentations: a slide per line, on two layouts of a master with a theme.

    Slides with a number divisible by 4 have no layout; the second layout has no master.
    """

    def many(name: str, content: str) -> str:
        entry = f"named_struct('name', {name}, 'content', {content})".replace("{i}", "(j + 1)")
        return f"transform(lines, (x, j) -> {entry})"

    links = (
        "concat('<Relationships>', if({i} % 4 = 0, '', concat('<Relationship Id=\"r1\" Type=\"http://example.org/rel/slideLayout\" "
        "Target=\"../slideLayouts/slideLayout', {i} % 2 + 1, '.xml\"/>')), '</Relationships>')"
    )
    layout = _relationship("'r1'", "slideMaster", "'../slideMasters/slideMaster1.xml'")
    files = ", ".join(
        [
            _file("'ppt/presentation.xml'", "'<p:presentation/>'"),
            _file("'ppt/slideLayouts/slideLayout1.xml'", "'<p:sldLayout/>'"),
            _file("'ppt/slideLayouts/_rels/slideLayout1.xml.rels'", _rels(layout)),
            _file("'ppt/slideLayouts/slideLayout2.xml'", "'<p:sldLayout/>'"),
            _file("'ppt/slideMasters/slideMaster1.xml'", "'<p:sldMaster/>'"),
            _file(
                "'ppt/slideMasters/_rels/slideMaster1.xml.rels'",
                _rels(
                    _relationship("'r1'", "slideLayout", "'../slideLayouts/slideLayout1.xml'"),
                    _relationship("'r2'", "theme", "'../theme/theme1.xml'"),
                ),
            ),
            _file("'ppt/theme/theme1.xml'", "'<a:theme/>'"),
        ]
    )
    base = spread(t.conversations).selectExpr("concat('c', conv_id, '-', turn) AS package", "split(text, '\\n') AS lines")
    return base.selectExpr(
        "package",
        f"concat(array({files}), {many('concat(' + repr('ppt/slides/slide') + ', {i}, ' + repr('.xml') + ')', repr('<p:sld/>'))}, "
        f"{many('concat(' + repr('ppt/slides/_rels/slide') + ', {i}, ' + repr('.xml.rels') + ')', links)}) AS files",
    )


def media_files(t: Tables) -> DataFrame:
    """Parts as packages with something of each kind that has a preview, and of each that fails.

    A WebP header holds one less than the width.
    """
    be = lambda n: f"unhex(lpad(hex({n}), 8, '0'))"
    le = lambda n: f"unhex(concat_ws('', lpad(hex({n} % 256), 2, '0'), lpad(hex({n} div 256), 2, '0'), '00'))"
    side = "(p_partkey * 13 % 9000 + 1)"
    types = (
        "'<Types><Default Extension=\"xml\" ContentType=\"application/xml\"/><Default Extension=\"DAT\" "
        "ContentType=\"image/svg+xml; charset=x\"/><Override PartName=\"/o/./typed.bin\" ContentType=\"application/x+json\"/></Types>'"
    )

    def binary(name: str, content: str) -> str:
        return _file(f"'{name}'", f"CAST({content} AS binary)")

    files = ", ".join(
        [
            binary("[Content_Types].xml", types),
            binary("a.xml", "concat('<?xml version=\"1.0\"?><p><n>', p_partkey, '</n><![CDATA[<]]></p>')"),
            binary("b.xml", "concat('<p>', p_partkey, '</q>')"),
            binary("t.dat", "'<svg/>'"),
            binary("c.json", "concat('{\"b\": [', p_partkey, '], \"a\": null}')"),
            binary("d.json", "X'7BFF'"),
            binary("o/typed.bin", "concat('[', p_size, ']')"),
            binary("i.png", f"concat(X'89504E470D0A1A0A0000000D49484452', {be(side)}, {be('p_size')}, X'0802000000')"),
            binary("w.webp", f"concat(CAST('RIFF----WEBPVP8X' AS binary), X'0A00000000000000', {le(f'({side} - 1)')}, {le('p_size')})"),
            binary("x.webp", "'no image'"),
            binary("r.bin", "'AB'"),
            binary("s.txt", "p_name"),
        ]
    )
    return spread(t.part).selectExpr("concat('m', p_partkey) AS package", f"array({files}) AS files")


def damaged_packages(t: Tables, packed: DataFrame) -> DataFrame:
    """Of packages `c<key>`, those with a key of 1 more than a fifth multiple have lost their end."""
    key = F.substring("package", 2, 20).cast("long")
    return packed.withColumn("content", F.expr("if(CAST(substring(package, 2) AS bigint) % 5 = 1, substring(content, 1, 60), content)")).where(key.isNotNull())


def faulty_files(t: Tables) -> DataFrame:
    """Customers as packages with faults: by `c_custkey % 5`, none, none yet, malformed content types, a
    relationships part that is too long to be read, or too many entries."""
    long_rels = "concat('<Relationships>', repeat(' ', if(c_custkey % 5 = 3, 1000, 0)), '</Relationships>')"
    types = f"if(c_custkey % 5 = 2, '<Types></Broken>', {TYPES_XML})"
    files = ", ".join([_file("'[Content_Types].xml'", types), _file("'_rels/.rels'", long_rels), _file("'a.xml'", "'<a/>'")])
    more = "transform(sequence(1, 9), n -> named_struct('name', concat('x', n), 'content', ''))"
    return spread(t.customer).selectExpr(
        "concat('c', c_custkey) AS package", f"if(c_custkey % 5 = 4, concat(array({files}), {more}), array({files})) AS files"
    )


def file_parts(files: DataFrame, *endings: str) -> DataFrame:
    """The files as read parts `(package, ord, path, archive_name, content)`, unzipped from the
    start; `endings` keeps only paths that end so."""
    parts = files.select(
        "package", F.posexplode("files").alias("ord", "file")
    ).select(
        "package",
        "ord",
        F.concat(F.lit("/"), F.col("file.name")).alias("path"),
        F.col("file.name").alias("archive_name"),
        F.col("file.content").cast("binary").alias("content"),
    )
    return parts.filter(_ends_so(endings)) if endings else parts


def file_names(files: DataFrame, *endings: str) -> DataFrame:
    """`file_parts` without contents, which are not made for it either."""
    names = files.select("package", F.col("files.name").alias("names")).select(
        "package", F.posexplode("names").alias("ord", "archive_name")
    )
    parts = names.select("package", "ord", F.concat(F.lit("/"), F.col("archive_name")).alias("path"), "archive_name")
    return parts.filter(_ends_so(endings)) if endings else parts


def _ends_so(endings: tuple[str, ...]) -> Column:
    keep = F.lit(False)
    for ending in endings:
        keep = keep | F.col("path").endswith(ending)
    return keep


def file_relationships(files: DataFrame, *endings: str, events: DataFrame | None = None) -> DataFrame:
    """Relationships of the files; of `events`, if there are written tokens with their `Relationship` elements."""
    endings = endings or (".rels",)
    if events is None:
        # Read three times: rows, malformed parts, incomplete parts.
        events = staged(I.relationship_tokens(file_parts(files, *endings)), "rels-tokens")
    else:
        events = events.filter(_ends_so(endings))
    return I.parse_relationships(events, I.relationship_parts(file_names(files, *endings)))


# Orders as one workbook ---------------------------------------------------------------------


def order_cells(t: Tables) -> DataFrame:
    """Lines as cells of one workbook: fourth lines are plain values, fifth ones no positions,
    sixth ones positions out of range."""
    return t.lineitem.selectExpr(
        "'book' AS package",
        "concat('/xl/worksheets/', l_orderkey, '.xml') AS path",
        "concat('A', l_linenumber) AS reference",
        "if(l_linenumber % 4 = 0, NULL, 's') AS cell_type",
        "concat(if(l_linenumber = 3, '+', ''), l_partkey, "
        "CASE l_linenumber WHEN 5 THEN 'x' WHEN 6 THEN '000000000' ELSE '' END) AS value",
    )


def part_strings(t: Tables) -> DataFrame:
    """Part names as shared strings."""
    return t.part.selectExpr(
        "'book' AS package", "CAST(p_partkey AS int) AS idx", "p_name AS value"
    )


# Images -------------------------------------------------------------------------------------


def part_images(t: Tables) -> DataFrame:
    """Parts as images of four formats: headers with sizes that follow from the row."""
    be = lambda n: f"unhex(lpad(hex({n}), 8, '0'))"
    le16 = lambda n: f"unhex(concat(lpad(hex({n} % 256), 2, '0'), lpad(hex({n} div 256), 2, '0')))"
    w = "(p_partkey * 13 % 9000 + 1)"
    h = "(p_size * 500 + 1)"
    png = f"concat(X'89504E470D0A1A0A0000000D49484452', {be(w)}, {be(h)}, X'0802000000')"
    gif = f"concat(X'474946383961', {le16(w)}, {le16(h)}, X'F70000')"
    bmp = f"concat(X'424D00000000000000003600000028000000', {le16(w)}, X'0000', {le16(h)}, X'000001001800')"
    jpeg = (
        f"concat(X'FFD8FFE000044A46FFC0001108', unhex(lpad(hex({h}), 4, '0')), "
        f"unhex(lpad(hex({w}), 4, '0')), X'03011100')"
    )
    return t.part.selectExpr(
        "p_brand AS package",
        "concat('/media/', p_partkey) AS path",
        "concat('media/', p_partkey, '.', element_at(array('PNG', 'gif', 'bmp', 'jpeg'), "
        "CAST(p_partkey % 4 AS int) + 1)) AS archive_name",
        f"CASE WHEN p_partkey % 50 = 7 THEN CAST('broken' AS binary) "
        f"WHEN p_partkey % 4 = 0 THEN {png} WHEN p_partkey % 4 = 1 THEN {gif} "
        f"WHEN p_partkey % 4 = 2 THEN {bmp} ELSE {jpeg} END AS content",
    )
