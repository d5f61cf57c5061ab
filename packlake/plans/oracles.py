"""The same results as plain SQL over the base tables, for comparison on another engine.

Written from what each operator means, not from how it is built here: packages, XML and
containers never appear, only the rows they were made from.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def absolute(x: str) -> str:
    """Normalised path with leading slash; '' if nothing is left."""
    return (
        f"list_reduce(list_filter(string_split(replace({x}, chr(92), '/'), '/'), "
        "lambda c: c <> '' AND c <> '.'), "
        "lambda a, c: CASE WHEN c = '..' THEN regexp_replace(a, '/[^/]*$', '') "
        "ELSE a || '/' || c END, '')"
    )


def extension(x: str) -> str:
    return lower(f"regexp_extract(rtrim({x}, '/'), '[^/]\\.([^./]*)$', 1)")


def is_xml_type(x: str) -> str:
    head = lower(f"trim(split_part({x}, ';', 1))")
    return f"({head} IN ('application/xml', 'text/xml') OR {head} LIKE '%+xml')"


SPACES = "[\\t\\n\\x0b\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'), ' ')"


def nodes_of(path: str) -> str:
    """List of the path and all above it."""
    pieces = f"string_split(substr({path}, 2), '/')"
    return (
        f"list_transform(range(1, len({pieces}) + 1), "
        f"lambda i: '/' || array_to_string({pieces}[1:i], '/'))"
    )


SIZE = "octet_length(encode({}))".format

# Pages as entries ---------------------------------------------------------------------------

PAGES = f"""
base AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS package,
         regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS p, {SIZE('html')} AS n
  FROM pages),
entries AS (
  SELECT package, page_id * 16 + k AS ord, archive_name,
         archive_name LIKE '%/' OR right(archive_name, 1) = chr(92) AS is_dir,
         n + k AS size, (n + k) // 3 AS compressed_size
  FROM (SELECT page_id, package, n, unnest(range(9)) AS k, unnest([
      p, 'word/./' || p || '.XML', '/media/' || page_id || '.PnG', 'a/../' || p || '/',
      p || chr(92) || 'data' || chr(92) || 'item.bin', '_rels/' || p || '.rels',
      CASE WHEN page_id % 10 = 0 THEN repeat('d/', 64) || page_id ELSE '//x///' || p || '.json' END,
      CASE WHEN page_id % 3 = 0 THEN './' || p ELSE './' END,
      'custom.' || (page_id % 7)]) AS archive_name
    FROM base)),
named AS (
  SELECT *, {absolute('archive_name')} AS path,
         regexp_matches(archive_name, '(^|/)\\.\\.(/|$)') OR archive_name LIKE '/%'
           OR contains(archive_name, chr(92)) AS unsafe
  FROM entries),
accepted AS (
  SELECT * FROM named WHERE package NOT IN (
    SELECT package FROM entries GROUP BY package
    HAVING count(*) > 100000 OR sum(size) > 268435456)),
fitting AS (
  SELECT *, row_number() OVER (PARTITION BY package, path ORDER BY ord) AS copy
  FROM accepted WHERE path <> '' AND len(string_split(path, '/')) - 1 <= 64),
indexed AS (
  SELECT package, ord, path, archive_name, size, compressed_size,
         CASE WHEN is_dir THEN 'Directory'
              WHEN {extension('archive_name')} IN ('xml', 'rels') THEN 'Xml'
              WHEN {extension('archive_name')} IN ('png', 'jpg', 'jpeg', 'gif', 'bmp', 'webp') THEN 'Image'
              ELSE 'Binary' END AS kind
  FROM fitting WHERE copy = 1),
defaults AS (
  SELECT package, ext, arg_max(typ, page_id) AS typ
  FROM (SELECT package, page_id, unnest(['xml', 'png', 'bin', '1', '2']) AS ext,
               unnest(['application/xml', 'image/png',
                 CASE WHEN page_id % 2 = 0 THEN 'application/x-bin' ELSE 'IMAGE/x-raw' END,
                 'text/xml ; charset=utf-8',
                 CASE WHEN page_id % 3 = 0 THEN 'Application/VND.a+XML' ELSE 'text/plain' END]) AS typ
        FROM base)
  GROUP BY ALL),
overrides AS (
  SELECT package, {absolute('p')} AS path,
         arg_max(CASE page_id % 4 WHEN 0 THEN 'application/vnd.x+xml' WHEN 1 THEN 'image/svg'
                 ELSE 'text/plain' END, page_id) AS typ
  FROM base GROUP BY ALL),
typed AS (
  SELECT i.*, coalesce(o.typ, d.typ) AS content_type
  FROM indexed i
  LEFT JOIN overrides o ON o.package = i.package AND o.path = i.path
  LEFT JOIN defaults d ON d.package = i.package
    AND d.ext = {lower("regexp_extract(i.path, '[^.]*$')")}),
parts AS (
  SELECT * REPLACE (CASE WHEN kind <> 'Binary' THEN kind
                WHEN {is_xml_type('content_type')} THEN 'Xml'
                WHEN {lower('content_type')} LIKE 'image/%' THEN 'Image' ELSE kind END AS kind)
  FROM typed),
climbed AS (
  SELECT package, path, unnest({nodes_of('path')}) AS node FROM parts),
tree AS (
  SELECT package, node,
         nullif(regexp_extract(node, '^(.*)/', 1), '') AS parent,
         len(string_split(node, '/')) - 1 AS depth,
         regexp_extract(node, '[^/]*$') AS name, bool_and(node = path) AS is_leaf
  FROM climbed GROUP BY package, node),
folders AS (
  SELECT DISTINCT package, node AS path FROM climbed WHERE node <> path
  UNION SELECT package, path FROM parts WHERE kind = 'Directory')"""

# Keys as graph ------------------------------------------------------------------------------


def _keyed(table: str, name: str, key: str, label: str) -> str:
    return f"""SELECT '/{name}/' || {key} AS path,
      CASE WHEN {key} % 5 = 0 THEN './' ELSE '' END || '{name}/' || {key} AS archive_name,
      CASE WHEN {key} % 3 = 0 THEN NULL ELSE 'application/vnd.{name}+xml' END AS content_type,
      {SIZE(label)} AS size, {SIZE(label)} // 2 AS compressed_size,
      CASE {key} % 3 WHEN 0 THEN 'Binary/unsupported' WHEN 1 THEN 'XML' ELSE 'Image' END AS kind_label
    FROM {table}"""


GRAPH = f"""
parts AS (
  {_keyed('region', 'region', 'r_regionkey', 'r_name')}
  UNION ALL {_keyed('nation', 'nation', 'n_nationkey', 'n_name')}
  UNION ALL {_keyed('customer', 'customer', 'c_custkey', 'c_name')}
  UNION ALL {_keyed('supplier', 'supplier', 's_suppkey', 's_name')}
  UNION ALL {_keyed('part', 'part', 'p_partkey', 'p_name')}
  UNION ALL {_keyed('orders', 'orders', 'o_orderkey', 'o_orderpriority')}),
rels AS (
  SELECT *, CASE WHEN external THEN NULL ELSE goal END AS resolved_target,
         CASE WHEN external THEN 'External' ELSE 'Internal' END AS target_mode
  FROM (
    SELECT '/nation/' || n_nationkey AS source, 'r1' AS id, 1 AS rel_ord, 'region' AS typ,
           '../region/' || n_regionkey AS target, '/region/' || n_regionkey AS goal, false AS external
    FROM nation
    UNION ALL SELECT '/customer/' || c_custkey, 'r1', 1, 'nation', '/nation/' || c_nationkey,
           '/nation/' || c_nationkey, false FROM customer
    UNION ALL SELECT '/supplier/' || s_suppkey, 'r1', 1, 'nation', '.././nation//' || s_nationkey,
           '/nation/' || s_nationkey, false FROM supplier
    UNION ALL SELECT '/orders/' || o_orderkey, 'r1', 1, 'customer', '../customer/' || o_custkey,
           '/customer/' || o_custkey, o_orderkey % 7 = 0 FROM orders
    UNION ALL SELECT '/orders/' || l_orderkey, 'p' || l_linenumber, l_partkey * 10 + l_linenumber,
           'image', 'x/../../part/' || CASE WHEN l_linenumber = 7 THEN 'lost/' ELSE '' END || l_partkey,
           '/part/' || CASE WHEN l_linenumber = 7 THEN 'lost/' ELSE '' END || l_partkey,
           (l_orderkey + l_linenumber) % 7 = 0 FROM lineitem)),
nodes AS (SELECT DISTINCT unnest({nodes_of('path')}) AS path FROM parts)"""

# Documents as parts -------------------------------------------------------------------------

DOCS = f"""
docs AS (
  SELECT *, 'docs/' || lang || '/' || doc_id || '.' || ext AS archive_name,
         '/docs/' || lang || '/' || doc_id || '.' || ext AS path
  FROM (
    SELECT doc_id, lang, source AS package, text,
           ['txt', 'json', 'bin', 'xml', 'ttf', 'mp3', 'dat', 'PNG'][doc_id % 8 + 1] AS ext,
           [NULL, 'application/json', 'application/vnd.ms-office.vbaProject',
            'text/xml; charset=utf-8', 'audio/x-test', NULL, NULL][doc_id % 7 + 1] AS content_type,
           {SIZE('text')} AS size, {SIZE('text')} // 2 AS compressed_size,
           CASE WHEN doc_id % 9 = 0 THEN NULL
                WHEN doc_id % 10 = 1 THEN text || chr(7) ELSE text END AS shown,
           CASE WHEN doc_id % 9 = 0 THEN '\\xFF\\x00'::BLOB || encode(text)
                WHEN doc_id % 10 = 1 THEN encode(text || chr(7))
                WHEN doc_id % 11 = 0 THEN '\\xEF\\xBB\\xBF'::BLOB || encode(text)
                ELSE encode(text) END AS content
    FROM documents)),
flags AS (
  SELECT *, ext = 'json' OR coalesce(content_type, '') = 'application/json' AS is_json,
         ext = 'bin' AS is_bin, ext = 'ttf' AS is_font,
         ext = 'mp3' OR coalesce(content_type, '') LIKE 'audio/%' AS is_media,
         coalesce(content_type, '') LIKE '%vba%' AS is_ole
  FROM docs),
kinds AS (
  SELECT *, CASE WHEN ext = 'PNG' THEN 'Image'
      WHEN ext = 'xml' OR coalesce(content_type, '') LIKE 'text/xml%' THEN 'Xml'
      WHEN is_json THEN CASE WHEN shown IS NULL THEN 'Error' ELSE 'Json' END
      WHEN is_ole OR is_font OR is_media THEN 'Info'
      WHEN is_bin THEN 'Hex'
      WHEN shown IS NOT NULL AND NOT regexp_matches(shown, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]')
        THEN 'PlainText' ELSE 'Info' END AS preview_kind,
    CASE WHEN is_ole THEN 'OLE/VBA object' WHEN is_font THEN 'Font' WHEN is_media THEN 'Media'
      ELSE 'Binary data' END AS category,
    CASE ext WHEN 'ttf' THEN 'font/ttf' WHEN 'mp3' THEN 'audio/mpeg'
      ELSE 'application/octet-stream' END AS mime
  FROM flags),
infos AS (
  SELECT *, 'Binary file' || chr(10) || chr(10) || 'Name:       ' || archive_name || chr(10)
    || 'Category:   ' || category || chr(10) || 'MIME type:  ' || coalesce(content_type, mime) || chr(10)
    || 'Size:       ' || size || ' bytes' || chr(10) || 'Compressed: ' || compressed_size || ' bytes'
    || chr(10) || chr(10) || 'Raw bytes are not rendered for this file type.' AS info
  FROM kinds),
dumped AS (
  SELECT package, path, pos // 16 AS line,
         format('{{:08x}}', pos) || '  ' || left(spaced, 24) || ' ' || substr(spaced, 25)
           || ' |' || printable || '|' AS text
  FROM (
    SELECT package, path, pos,
           rpad(regexp_replace(lower(substr(digits, pos * 2 + 1, 32)), '(..)', '\\1 ', 'g'), 48, ' ') AS spaced,
           regexp_replace(array_to_string(list_transform(
             regexp_extract_all(substr(digits, pos * 2 + 1, 32), '..'),
             lambda b: chr(('0x' || b)::INTEGER)), ''), '[^ -~]', '.', 'g') AS printable
    FROM (SELECT package, path, hex(content) AS digits,
                 unnest(range(0, octet_length(content), 16)) AS pos FROM docs))),
dumps AS (
  SELECT package, path, string_agg(text || chr(10), '' ORDER BY line) AS text
  FROM dumped GROUP BY ALL)"""

# Page links ---------------------------------------------------------------------------------

LINKS = f"""
page AS (
  SELECT page_id, 'page-' || page_id AS package,
         rtrim(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/') AS q,
         regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs
  FROM pages),
link AS (
  SELECT *, CASE WHEN i % 3 = 1 THEN '../' || substr(h, 2) ELSE h END AS target
  FROM (SELECT page_id, package, q, unnest(hrefs) AS h, unnest(range(len(hrefs))) AS i FROM page)),
relation AS (
  SELECT package, '/' || q AS source, 'rId' || i AS id, 'http://example.org/rel/link' || (i % 2) AS relationship_type,
         target, CASE WHEN i % 5 = 4 THEN 'External' ELSE 'Internal' END AS target_mode,
         CASE WHEN i % 5 = 4 THEN NULL
              ELSE {absolute("CASE WHEN target LIKE '/%' THEN target ELSE regexp_extract('/' || q, '^(.*)/', 1) || '/' || target END")}
         END AS resolved_target
  FROM link WHERE page_id % 13 <> 0 AND page_id % 17 <> 0 AND page_id % 19 <> 0)"""

# Conversation decks -------------------------------------------------------------------------

DECKS = f"""
turns AS (
  SELECT 'c' || conv_id || '-' || turn AS package, role = 'assistant' AS noted,
         (conv_id + turn) % 29 = 0 AS broken, string_split(text, chr(10)) AS lines
  FROM conversations),
slides AS (
  SELECT package, noted, broken, n, i, n - i + 1 AS slide_no, x,
         '/ppt/slides/slide' || i || '.xml' AS path,
         CASE WHEN i % 4 = 0 OR {clean('x')} = '' THEN NULL ELSE {clean('x')} END AS title,
         i % 3 AS images,
         CASE WHEN noted AND i % 2 = 1 THEN '/ppt/notesSlides/notesSlide' || i || '.xml' END AS notes_path,
         CASE WHEN noted AND i % 2 = 1 THEN {clean("'Notes  on ' || x")} END AS notes_text
  FROM (SELECT package, noted, broken, len(lines) AS n, unnest(lines) AS x,
               unnest(range(1, len(lines) + 1)) AS i FROM turns))"""

WORDS = f"""
lines AS (
  SELECT doc_id, 'd' || doc_id AS package, unnest(string_split(text, chr(10))) AS x,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
  FROM documents),
styled AS (
  SELECT *, CASE WHEN i = 1 THEN 1 WHEN i % 5 = 0 THEN 2 END AS level, {clean('x')} AS heading FROM lines),
headings AS (
  SELECT package, row_number() OVER (PARTITION BY package ORDER BY i) AS ord, level, heading
  FROM styled WHERE level IS NOT NULL AND heading <> '')"""

BOOKS = """
books AS (
  SELECT c_custkey AS k, 'w' || c_custkey AS package, c_name AS name, c_mktsegment AS segment,
         c_nationkey AS nation, CAST(round(c_acctbal * 100) AS BIGINT) AS cents
  FROM customer),
cells AS (
  SELECT package, '/xl/worksheets/sheet1.xml' AS path,
         unnest([1, 2, 3, 4, 5, 6, 7]) AS ord,
         unnest(['A1', 'B1', 'C1', 'D1', 'E1', 'F1', 'G1']) AS reference,
         unnest(['s', 's', NULL, NULL, 'inlineStr', 's', NULL]) AS cell_type,
         unnest([name, segment || ' & co', cents::VARCHAR, (cents * nation)::VARCHAR, name, '', '']) AS value,
         unnest([NULL, NULL, NULL, 'C1*' || nation, NULL, NULL, NULL]) AS formula
  FROM books
  UNION ALL
  SELECT package, '/xl/worksheets/sheet2.xml', n, 'A' || n, NULL, (n * k)::VARCHAR, NULL
  FROM (SELECT package, k, unnest(range(1, 19 + k % 6)) AS n FROM books)),
sheets AS (
  SELECT package, 1 AS ord, 'Main' AS name, 'rId1' AS rel_id, '/xl/worksheets/sheet1.xml' AS path FROM books
  UNION ALL SELECT package, 2, 'List & more', 'rId2', '/xl/worksheets/sheet2.xml' FROM books
  UNION ALL SELECT package, 3, 'Lost', 'rId9', NULL FROM books WHERE k % 5 = 0)"""


LEDGERS = """
ledgers AS (
  SELECT c_custkey AS k, 'w' || c_custkey AS package, c_nationkey + 2 AS n, c_custkey % 4 = 0 AS looped FROM customer),
rows AS (SELECT *, unnest(range(1, n + 1)) AS i FROM ledgers),
cells AS (
  SELECT package, 1 AS sheet, 'A' || i AS reference, 1 AS col, i AS row FROM rows
  UNION ALL SELECT package, 1, 'B' || i, 2, i FROM rows
  UNION ALL SELECT package, 1, 'C' || i, 3, i FROM rows
  UNION ALL SELECT package, 1, unnest(['D1', 'D2', 'E1', 'F3', 'A' || (n + 1), 'B' || (n + 1)]),
                   unnest([4, 4, 5, 6, 1, 2]), unnest([1, 2, 1, 3, n + 1, n + 1]) FROM ledgers
  UNION ALL SELECT package, 2, unnest(['A1', 'A2', 'B2']), unnest([1, 1, 2]), unnest([1, 2, 2]) FROM ledgers),
areas AS (
  SELECT package, 1 AS sheet, 'merge' AS kind, 'A' || (n + 1) || ':C' || (n + 2) AS ref, 'A' || (n + 1) AS anchor,
         n + 1 AS top, 1 AS first, n + 2 AS bottom, 3 AS last FROM ledgers
  UNION ALL SELECT package, 1, 'merge', 'E2:F3', 'E2', 2, 5, 3, 6 FROM ledgers
  UNION ALL SELECT package, 1, 'Totals', '$B$1:$B$' || n, NULL, 1, 2, n, 2 FROM ledgers
  UNION ALL SELECT package, 2, 'Local', '$A:$A', NULL, 1, 1, 1048576, 1 FROM ledgers),
covered AS (
  SELECT c.*, a.kind, a.ref, a.anchor FROM cells c JOIN areas a
  ON c.package = a.package AND c.sheet = a.sheet AND c.row BETWEEN a.top AND a.bottom AND c.col BETWEEN a.first AND a.last),
refs AS (
  SELECT package, 'B' || i AS reference, 1 AS sheet, i AS top, 1 AS first, i AS bottom, 1 AS last FROM rows
  UNION ALL SELECT package, 'B' || i, 1, i - 1, 2, i - 1, 2 FROM rows WHERE i > 1
  UNION ALL SELECT package, 'C' || i, 1, 1, 2, i, 2 FROM rows
  UNION ALL SELECT package, 'E1', 1, 1, 2, n, 2 FROM ledgers
  UNION ALL SELECT package, 'D1', 1, 2, 4, 2, 4 FROM ledgers WHERE looped
  UNION ALL SELECT package, 'D2', 1, 1, unnest([1, 4]), 1, unnest([1, 4]) FROM ledgers WHERE looped
  UNION ALL SELECT package, 'D1', 2, 1, 1, 1, 1 FROM ledgers WHERE NOT looped)"""


def _sheet_events() -> str:
    """Tokens of the first sheet of a workbook, with the text of each value."""
    rows: list[str] = []

    def add(event, qname, depth, n_attrs=0, text="NULL"):
        name = f"'{qname}'" if qname else "NULL"
        rows.append(
            f"{{'seq': {len(rows)}, 'event': '{event}', 'qname': {name}, 'depth': {depth}, "
            f"'n_attrs': {n_attrs}, 'text': {text}}}"
        )

    def cell(n_attrs, *path_and_text):
        add("Start", "c", 3, n_attrs)
        for path, text in path_and_text:
            for i, name in enumerate(path):
                add("Start", name, 4 + i)
            add("Text", None, 4 + len(path), 0, text)
            for i, name in reversed(list(enumerate(path))):
                add("End", name, 4 + i)
        add("End", "c", 3)

    add("Start", "worksheet", 0)
    add("Empty", "dimension", 1, 1)
    add("Start", "sheetData", 1)
    add("Start", "row", 2)
    cell(2, (["v"], "'0'"))
    cell(2, (["v"], "'1'"))
    cell(1, (["v"], "cents::VARCHAR"))
    cell(1, (["f"], "'C1*' || nation"), (["v"], "(cents * nation)::VARCHAR"))
    cell(2, (["is", "t"], "name"))
    cell(2, (["v"], "'99'"))
    add("Empty", "c", 3, 1)
    for name, depth in [("row", 2), ("sheetData", 1), ("worksheet", 0)]:
        add("End", name, depth)
    return "[" + ", ".join(rows) + "]"


SHEET_EVENTS = _sheet_events()


def report(source: str, order: str, package: str = "package") -> str:
    """Report lines `raw(package, …order…, text, target)` numbered, with link spans."""
    return f"""
numbered AS (
  SELECT {package} AS package, row_number() OVER (PARTITION BY {package} ORDER BY {order}) - 1 AS line,
         text, target FROM {source})
SELECT package, line, text,
       CASE WHEN target IS NOT NULL THEN strpos(text, target) - 1 END AS link_start,
       CASE WHEN target IS NOT NULL THEN strpos(text, target) - 1 + length(target) END AS link_end,
       target AS link_target
FROM numbered"""


def pages_query(select: str) -> str:
    return f"WITH {PAGES} {select}"


def graph_query(select: str) -> str:
    return f"WITH {GRAPH} {select}"


LABEL = "CASE WHEN target_mode = 'External' THEN target || ' (external)' ELSE resolved_target END"


def short(x: str) -> str:
    return f"CASE WHEN length({x}) > 48 THEN left({x}, 48) || '…' ELSE {x} END"


EXT_LABEL = f"""CASE WHEN (package, path) IN (SELECT (package, path) FROM folders) THEN 'Directory'
  WHEN {extension('path')} IN ('xml', 'rels') THEN 'XML'
  WHEN {extension('path')} IN ('png', 'jpg', 'jpeg', 'gif', 'bmp', 'webp') THEN 'Image'
  ELSE 'Binary/unsupported' END"""

WORD_XML = """'<w:document xmlns:w="w"><w:body><w:p/>' || string_agg('<w:p>'
  || CASE WHEN i = 1 THEN '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
          WHEN i % 5 = 0 THEN '<w:pPr><w:pStyle w:val="Heading+2"></w:pStyle></w:pPr>'
          WHEN i % 7 = 0 THEN '<w:pPr><w:pStyle w:val="HeadingX"/></w:pPr>' ELSE '' END
  || '<w:r><w:t>' || replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')
  || '</w:t></w:r><w:instrText>skip</w:instrText></w:p>', '' ORDER BY i)
  || CASE WHEN doc_id % 4 = 0 THEN '<w:tbl/>' ELSE '' END || '</w:body></w:document>'"""

TYPES_BYTES = 232  # the content-types part all made packages share

WORD_FILES = f"""
files AS (
  SELECT package, unnest(['[Content_Types].xml', '_rels/.rels', 'word/document.xml', 'word/_rels/document.xml.rels']) AS archive_name,
         unnest([0, 1, 2, 3]) AS ord,
         unnest([{TYPES_BYTES}, octet_length(encode('<Relationships><Relationship Id="rId1" Type="http://example.org/rel/officeDocument" Target="word/document.xml"/></Relationships>')),
           octet_length(encode(xml)),
           octet_length(encode('<Relationships></Relationships>')) + (doc_id % 3) * octet_length(encode(
             '<Relationship Id="img1" Type="http://example.org/rel/image" TargetMode="External" Target="http://x/1"/>'))]) AS size
  FROM (SELECT doc_id, package, {WORD_XML} AS xml FROM lines GROUP BY doc_id, package))"""

XML_BODY = """'<c id="' || c_custkey || '">' || chr(10) || '  <!-- > -->' || chr(10) || '  <n a=''>''>' || c_name || '</n>'
  || chr(10) || '  <e />' || chr(10) || '  <o>' || chr(10) || '    <i>' || chr(10) || '      <b>' || chr(10)
  || '      </b>' || chr(10) || '    </i>' || chr(10) || '  </o>' || chr(10) || '</c>'"""

_B_W, _B_H = "(p_partkey * 13 % 9000 + 1)", "(p_size * 500 + 1)"

ORACLES: dict[str, str] = {
    # Sources.
    "scan_packages": "SELECT 'w' || c_custkey AS package, '504B0304' AS magic, true AS filled FROM customer",
    "bounded_read": f"""WITH {WORDS}, {WORD_FILES}
        SELECT package, archive_name, size, CASE WHEN size <= 2000 THEN size END AS got,
               CASE WHEN size > 2000 THEN 'entry declares ' || size || ' bytes; limit is 2000' END AS read_error
        FROM files""",
    "explode_packages": f"""WITH {WORDS}, {WORD_FILES}
        SELECT package, ord, archive_name, false AS is_dir, size, NULL::VARCHAR AS read_error FROM files""",
    "search_packages": f"""WITH {WORDS}, docs AS (SELECT package, {WORD_XML} AS xml FROM lines GROUP BY doc_id, package)
        SELECT package, needle, '/word/document.xml' AS path
        FROM (SELECT package, xml, unnest(['the ', 'queue', chr(10) || 'E', 'Ch', 'ü']) AS needle FROM docs)
        WHERE contains(xml, needle)""",
    "read_part": f"""WITH {WORDS}, docs AS (SELECT package, {WORD_XML} AS xml FROM lines GROUP BY doc_id, package)
        SELECT package, '/word/document.xml' AS path, md5(xml) AS digest, {SIZE('xml')} AS size,
               NULL::VARCHAR AS read_error FROM docs
        UNION ALL SELECT package, '/lost.xml', NULL, NULL, 'part not found: /lost.xml' FROM docs""",
    "write_index": pages_query("""SELECT 'parts' AS name, package, path AS item, kind AS value FROM parts
        UNION ALL SELECT 'directories', package, path, NULL FROM folders
        UNION ALL SELECT 'types', package, path, content_type FROM typed"""),
    "stream_packages": f"""WITH {BOOKS}
        SELECT package, '/' || unnest(['[Content_Types].xml', '_rels/.rels', 'xl/workbook.xml',
                 'xl/_rels/workbook.xml.rels', 'xl/sharedStrings.xml', 'xl/worksheets/sheet1.xml',
                 'xl/worksheets/sheet2.xml']) AS path,
               unnest(['application/xml', 'application/vnd.openxmlformats-package.relationships+xml', 'application/xml',
                 'application/vnd.openxmlformats-package.relationships+xml', 'application/xml', 'application/xml',
                 'application/xml']) AS content_type, 'Xml' AS kind FROM books""",
    "incremental_index": f"""WITH {BOOKS}
        SELECT package, unnest(['/', '/xl/workbook.xml', '/xl/workbook.xml']) AS source,
               unnest(['rId1', 'rId1', 'rId2']) AS id,
               unnest(['/xl/workbook.xml', '/xl/worksheets/sheet1.xml', '/xl/worksheets/sheet2.xml']) AS resolved_target,
               'Internal' AS target_mode FROM books""",
    "package_source": f"""WITH {WORDS}, {WORD_FILES}
        SELECT package, ord, archive_name, false AS is_dir, size, NULL::VARCHAR AS read_error FROM files""",
    "package_source_parts": f"""WITH {WORDS}, docs AS (SELECT package, {WORD_XML} AS xml FROM lines GROUP BY doc_id, package)
        SELECT package, md5(xml) AS digest, {SIZE('xml')} AS size FROM docs""",
    "preview_packages": """WITH m AS (SELECT p_partkey AS k, p_size AS h, p_name, 'm' || p_partkey AS package FROM part),
        shown AS (
          SELECT package, unnest(['/[Content_Types].xml', '/a.xml', '/b.xml', '/t.dat', '/c.json', '/d.json', '/o/typed.bin',
                                  '/i.png', '/w.webp', '/x.webp', '/r.bin', '/s.txt']) AS path,
                 unnest(['Xml', 'Xml', 'Error', 'Xml', 'Json', 'Error', 'Json',
                         CASE WHEN k * 13 % 9000 + 1 > 8192 THEN 'Error' ELSE 'Image' END,
                         CASE WHEN k * 13 % 9000 + 1 > 8192 THEN 'Error' ELSE 'Image' END, 'Error', 'Hex', 'PlainText']) AS preview_kind,
                 unnest(['<Types>' || chr(10) || '  <Default Extension="xml" ContentType="application/xml"/>' || chr(10)
                         || '  <Default Extension="DAT" ContentType="image/svg+xml; charset=x"/>' || chr(10)
                         || '  <Override PartName="/o/./typed.bin" ContentType="application/x+json"/>' || chr(10) || '</Types>',
                         '<?xml version="1.0"?>' || chr(10) || '<p>' || chr(10) || '  <n>' || k || '</n><![CDATA[<]]></p>', NULL, '<svg/>',
                         '{' || chr(10) || '  "a": null,' || chr(10) || '  "b": [' || chr(10) || '    ' || k || chr(10) || '  ]' || chr(10) || '}',
                         NULL, '[' || chr(10) || '  ' || h || chr(10) || ']', NULL, NULL, NULL,
                         '00000000  41 42' || repeat(' ', 44) || ' |AB|' || chr(10), p_name]) AS text
          FROM m)
        SELECT package, path, preview_kind, md5(text) AS digest, preview_kind = 'Error' AS failed FROM shown""",
    "container_diagnostics": """SELECT 'c' || c_custkey AS package, 'Error' AS severity,
          CASE c_custkey % 5 WHEN 2 THEN 'content-types' WHEN 3 THEN 'relationships' ELSE 'index' END AS stage,
          CASE c_custkey % 5 WHEN 2 THEN '/[Content_Types].xml' WHEN 3 THEN '/_rels/.rels' END AS part,
          CASE c_custkey % 5 WHEN 1 THEN 'File is not a zip file' WHEN 2 THEN 'mismatched tag'
               WHEN 3 THEN 'entry declares 1031 bytes; limit is 1000' ELSE 'archive has 12 entries; limit is 9' END AS message
        FROM customer WHERE c_custkey % 5 <> 0""",
    "search_many_needles": f"""WITH {WORDS}, docs AS (SELECT package, {WORD_XML} AS xml FROM lines GROUP BY doc_id, package),
        words AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark),
        hits AS (SELECT package, w FROM docs, words WHERE w <> '' AND contains(xml, w))
        SELECT package, '/word/document.xml' AS path, count(*) AS n_needles, md5(array_to_string(list_sort(list(w)), ' ')) AS digest
        FROM hits GROUP BY package""",
    # Facts of documents.
    "merged_anchors": f"""WITH {LEDGERS}
        SELECT c.package, '/xl/worksheets/sheet' || c.sheet || '.xml' AS path, c.reference, m.ref, m.anchor,
               c.reference = m.anchor AS is_anchor
        FROM cells c LEFT JOIN (SELECT * FROM covered WHERE kind = 'merge') m
        ON c.package = m.package AND c.sheet = m.sheet AND c.reference = m.reference""",
    "named_cells": f"""WITH {LEDGERS}
        SELECT package, '/xl/worksheets/sheet' || sheet || '.xml' AS path, reference, kind AS name, ref
        FROM covered WHERE kind <> 'merge'""",
    "formula_references": f"""WITH {LEDGERS}
        SELECT package, '/xl/worksheets/sheet1.xml' AS path, reference, '/xl/worksheets/sheet' || sheet || '.xml' AS ref_path,
               top, first AS first_column, bottom, last AS last_column FROM refs""",
    "formula_levels": f"""WITH {LEDGERS}, levels AS (
          SELECT package, unnest(['B' || i, 'C' || i]) AS reference, unnest([i, i + 1]) AS level, false AS in_cycle FROM rows
          UNION ALL SELECT package, 'E1', n + 1, false FROM ledgers
          UNION ALL SELECT package, unnest(['D1', 'D2']), CASE WHEN looped THEN NULL ELSE 1 END, looped FROM ledgers)
        SELECT package, '/xl/worksheets/sheet1.xml' AS path, reference, level, in_cycle FROM levels""",
    "styled_outline": f"""WITH {WORDS}
        SELECT package, style, level, inherited_from, heading AS text FROM (
          SELECT package, heading, CASE i % 5 WHEN 0 THEN 'S' || (doc_id % 6) WHEN 2 THEN 'Body' END AS style,
                 CASE i % 5 WHEN 0 THEN doc_id % 3 + 1 WHEN 2 THEN 2 END AS level,
                 CASE i % 5 WHEN 0 THEN 'S0' END AS inherited_from
          FROM styled) WHERE level IS NOT NULL AND text <> ''""",
    "style_inheritance": """SELECT 'd' || doc_id AS package, 'S' || m AS id, doc_id % 3 AS outline, m AS depth, false AS in_cycle
        FROM (SELECT doc_id, unnest(range(0, doc_id % 6 + 1)) AS m FROM documents)
        UNION ALL SELECT 'd' || doc_id, unnest(['Loop1', 'Loop2']), NULL, NULL, true FROM documents
        UNION ALL SELECT 'd' || doc_id, 'Body', 9, 0, false FROM documents""",
    "slide_chain": """SELECT package, '/ppt/slides/slide' || i || '.xml' AS path,
          CASE WHEN i % 4 <> 0 THEN '/ppt/slideLayouts/slideLayout' || (i % 2 + 1) || '.xml' END AS layout,
          CASE WHEN i % 4 = 2 THEN '/ppt/slideMasters/slideMaster1.xml' END AS master,
          CASE WHEN i % 4 = 2 THEN '/ppt/theme/theme1.xml' END AS theme,
          CASE i % 4 WHEN 0 THEN 0 WHEN 2 THEN 3 ELSE 1 END AS depth
        FROM (SELECT 'c' || conv_id || '-' || turn AS package, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
              FROM conversations)""",
    "document_links": f"""WITH {WORDS}, numbered AS (
          SELECT *, i + (i - 1) // 2 AS nth, count(*) OVER (PARTITION BY doc_id) AS n FROM styled)
        SELECT package, '/word/document.xml' AS path, nth AS ord, CASE WHEN i % 2 = 1 THEN 'hyperlink' ELSE 'field' END AS kind,
               1 AS depth, true AS closed, CASE WHEN i % 2 = 0 THEN 'HYPERLINK' END AS code,
               CASE WHEN i % 2 = 0 THEN 'http://y/' || i WHEN i % 3 = 0 THEN '#a' || i ELSE 'http://x/' || doc_id || '/' || i END AS target,
               CASE WHEN i % 2 = 1 THEN heading ELSE {clean("x || '7'")} END AS text FROM numbered
        UNION ALL SELECT package, '/word/document.xml', nth + 1, 'field', 2, true, 'PAGE', NULL, '7' FROM numbered WHERE i % 2 = 0
        UNION ALL SELECT DISTINCT package, '/word/document.xml', n + n // 2 + 1, 'field', 1, false, 'REF', NULL, ''
        FROM numbered WHERE doc_id % 5 = 0""",
    "reachable_parts": f"""WITH RECURSIVE {GRAPH}, walked AS (
          SELECT path, 0 AS hops FROM parts WHERE path LIKE '/orders/%'
          UNION SELECT p.path, hops + 1 FROM walked w JOIN rels r ON r.source = w.path
          JOIN parts p ON p.path = r.resolved_target WHERE hops < 9)
        SELECT 'sales' AS package, path, min(hops)::INT AS hops FROM walked GROUP BY path""",
    "orphan_parts": f"""WITH RECURSIVE {GRAPH}, walked AS (
          SELECT path, 0 AS hops FROM parts WHERE path LIKE '/orders/%'
          UNION SELECT p.path, hops + 1 FROM walked w JOIN rels r ON r.source = w.path
          JOIN parts p ON p.path = r.resolved_target WHERE hops < 9)
        SELECT 'sales' AS package, path FROM parts WHERE path NOT IN (SELECT path FROM walked)""",
    "unreached_slide_parts": f"""WITH {DECKS}
        SELECT package, '/ppt/presentation.xml' AS path, 1 AS hops FROM turns
        UNION ALL SELECT package, path, 2 FROM slides
        UNION ALL SELECT package, notes_path, 3 FROM slides WHERE notes_path IS NOT NULL""",
    "directory_totals": pages_query("""SELECT d.package, d.path AS node,
          (SELECT count(DISTINCT node) FROM (
             SELECT package, node, CASE WHEN node LIKE '/%/%' THEN regexp_replace(node, '/[^/]*$', '') ELSE '/' END AS up FROM climbed) c
           WHERE c.package = d.package AND c.up = d.path) AS n_children,
          count_if(p.kind <> 'Directory') AS n_parts,
          coalesce(sum(p.size) FILTER (p.kind <> 'Directory'), 0)::BIGINT AS size,
          coalesce(sum(p.compressed_size) FILTER (p.kind <> 'Directory'), 0)::BIGINT AS compressed_size,
          count_if(p.kind = 'Xml') AS n_xml, count_if(p.kind = 'Image') AS n_image, count_if(p.kind = 'Binary') AS n_binary
        FROM (SELECT package, path FROM folders UNION SELECT DISTINCT package, '/' FROM parts) d
        LEFT JOIN parts p ON p.package = d.package AND (d.path = '/' OR p.path LIKE d.path || '/%' OR starts_with(p.path, d.path || '/'))
        GROUP BY d.package, d.path"""),
    # Index.
    "normalize_path": pages_query("SELECT package, ord, archive_name, substr(path, 2) AS path FROM named"),
    "unsafe_name": pages_query("SELECT package, ord, archive_name, unsafe FROM named"),
    "depth_guard": pages_query(
        "SELECT package, ord, path FROM named WHERE path <> '' AND len(string_split(path, '/')) - 1 <= 64"
    ),
    "archive_limits": """SELECT package, n AS n_entries, CASE WHEN n > 6 THEN 'archive has ' || n || ' entries; limit is 6'
          ELSE 'declared uncompressed size exceeds 150000 bytes' END AS message
        FROM (SELECT 'order-' || l_orderkey AS package, count(*) AS n, sum(CAST(l_quantity AS BIGINT) * 1000) AS total
              FROM lineitem GROUP BY ALL) WHERE n > 6 OR total > 150000""",
    "dedupe_first_wins": pages_query("SELECT * FROM indexed"),
    "classify_kind": pages_query(f"""SELECT package, ord, archive_name,
        CASE WHEN is_dir THEN 'Directory' WHEN {extension('archive_name')} IN ('xml', 'rels') THEN 'Xml'
             WHEN {extension('archive_name')} IN ('png', 'jpg', 'jpeg', 'gif', 'bmp', 'webp') THEN 'Image'
             ELSE 'Binary' END AS kind FROM entries"""),
    "parse_content_types": f"""WITH {LINKS}, sound AS (SELECT * FROM link WHERE page_id % 13 <> 0)
        SELECT package, 'e' || (i % 3) AS name, 'text/t' || max(i) AS content_type, 'default' AS rule
        FROM sound GROUP BY package, i % 3
        UNION ALL
        SELECT package, coalesce(nullif({absolute('h')}, ''), '/'), 'application/x-' || max(i), 'override'
        FROM sound GROUP BY ALL""",
    "resolve_content_type": pages_query("SELECT package, path, content_type FROM typed"),
    "refine_kind": pages_query("SELECT package, path, content_type, kind FROM parts"),
    "is_xml_content_type": pages_query(
        f"SELECT package, path, {is_xml_type('content_type')} AS is_xml FROM parts"
    ),
    "relationship_source": f"""WITH {LINKS}
        SELECT package, CASE WHEN page_id % 19 = 0 THEN '/misc/' || page_id || '.RELS'
            ELSE regexp_replace('/' || q, '([^/]*)$', '_rels/\\1.rels') END AS path,
          CASE WHEN page_id % 19 = 0 THEN NULL ELSE '/' || q END AS source FROM page""",
    "parse_relationships": f"""WITH {LINKS}
        SELECT package, source, id, relationship_type, target, target_mode FROM relation""",
    "resolve_target": f"WITH {LINKS} SELECT package, source, target, resolved_target FROM relation",
    "resolve_target_keys": graph_query("SELECT source, id, target, resolved_target FROM rels"),
    "outgoing": graph_query("SELECT 'sales' AS package, source AS path, count(*) AS n_out FROM rels GROUP BY source"),
    "incoming": graph_query("""SELECT 'sales' AS package, resolved_target AS path, count(*) AS n_in
        FROM rels WHERE resolved_target IS NOT NULL GROUP BY resolved_target"""),
    "diagnostics": pages_query("""SELECT package, severity, stage, part, message, stage || ': ' || message AS warning FROM (
        SELECT package, 'Warning' AS severity, 'index' AS stage, archive_name AS part,
               'traversal-like archive name was normalized' AS message FROM accepted WHERE unsafe
        UNION ALL SELECT package, 'Warning', 'index', archive_name,
               'archive path exceeds maximum depth of 64; entry ignored'
        FROM accepted WHERE len(string_split(path, '/')) - 1 > 64
        UNION ALL SELECT package, 'Error', 'index', path,
               'archive path collides with ''' || archive_name || '''; entry ignored'
        FROM fitting WHERE copy > 1)"""),
    "relationship_diagnostics": f"""WITH {LINKS}, named AS (
          SELECT package, page_id, CASE WHEN page_id % 19 = 0 THEN '/misc/' || page_id || '.RELS'
            ELSE regexp_replace('/' || q, '([^/]*)$', '_rels/\\1.rels') END AS path FROM page)
        SELECT package, path, CASE WHEN page_id % 13 = 0 THEN 'malformed XML'
          ELSE 'Relationship is missing required Target attribute' END AS message
        FROM named WHERE page_id % 13 = 0 OR page_id % 17 = 0""",
    "is_directory": pages_query("""SELECT package, node AS path,
        (package, node) IN (SELECT (package, path) FROM folders) AS is_directory FROM tree"""),
    "xml_attr": f"""WITH {LINKS}
        SELECT package, id, NULL::VARCHAR AS prefixed, target FROM (
          SELECT package, 'rId' || i AS id, target FROM link WHERE page_id % 13 <> 0
          UNION ALL SELECT package, 'x', '' FROM page WHERE page_id % 17 = 0 AND page_id % 13 <> 0)""",
    # Tree and search.
    "tree_nodes": pages_query("SELECT * FROM tree"),
    "ancestors": pages_query("""SELECT package, path, len(string_split(node, '/')) - 2 AS level, node
        FROM climbed"""),
    "branch_nodes": pages_query("SELECT package, node FROM tree WHERE NOT is_leaf"),
    "filter_tree": pages_query(f"""SELECT * FROM tree t WHERE EXISTS (
        SELECT 1 FROM tree m WHERE m.package = t.package AND contains({lower('m.node')}, 'x/en')
          AND (m.node = t.node OR starts_with(m.node, t.node || '/') OR starts_with(t.node, m.node || '/')))"""),
    "filter_tree_matches": pages_query("""SELECT * FROM tree t WHERE EXISTS (
        SELECT 1 FROM parts m WHERE m.package = t.package AND m.kind = 'Image'
          AND (m.path = t.node OR starts_with(m.path, t.node || '/') OR starts_with(t.node, m.path || '/')))"""),
    "search_paths": pages_query(f"""SELECT package, path,
        row_number() OVER (PARTITION BY package ORDER BY path) - 1 AS rank
        FROM parts WHERE contains({lower('path')}, 'media/1')"""),
    "search_content": f"""WITH {DOCS}
        SELECT package, needle, path
        FROM (SELECT package, path, text, unnest(['the ', 'queue', chr(10) || 'E', 'Ch', 'ü']) AS needle FROM docs)
        WHERE contains(text, needle)""",
    # Details.
    "part_details": graph_query("""
        SELECT 'sales' AS package, n.path, substr(n.path, 2) AS display_name,
          CASE WHEN p.archive_name <> substr(n.path, 2) THEN p.archive_name END AS archive_name,
          coalesce(p.kind_label, 'Directory') AS kind_label,
          CASE WHEN p.path IS NULL THEN 'N/A' ELSE coalesce(p.content_type, 'Unknown') END AS content_type,
          p.size, p.compressed_size, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in,
          (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS n_warnings
        FROM nodes n LEFT JOIN parts p ON p.path = n.path
        LEFT JOIN (SELECT source, count(*) AS n FROM rels GROUP BY source) o ON o.source = n.path
        LEFT JOIN (SELECT resolved_target, count(*) AS n FROM rels GROUP BY resolved_target) i
          ON i.resolved_target = n.path"""),
    "details_lines": graph_query(f"""
        , degree AS (
          SELECT n.path, p.archive_name, p.kind_label, p.content_type, p.size, p.compressed_size, p.path IS NOT NULL AS is_part,
            coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in
          FROM nodes n LEFT JOIN parts p ON p.path = n.path
          LEFT JOIN (SELECT source, count(*) AS n FROM rels GROUP BY source) o ON o.source = n.path
          LEFT JOIN (SELECT resolved_target, count(*) AS n FROM rels GROUP BY resolved_target) i
            ON i.resolved_target = n.path)
        SELECT path, section, 0 AS ord, line, NULL::INTEGER AS link_start, NULL::INTEGER AS link_end,
               NULL::VARCHAR AS link_target
        FROM (SELECT path, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11]) AS section, unnest([
            'Part: ' || substr(path, 2),
            CASE WHEN archive_name <> substr(path, 2) THEN 'Archive: ' || archive_name END,
            'Kind: ' || coalesce(kind_label, 'Directory'),
            'Content type: ' || CASE WHEN is_part THEN coalesce(content_type, 'Unknown') ELSE 'N/A' END,
            'Size: ' || size || ' bytes (' || compressed_size || ' compressed)', '',
            'Relationships: ' || n_out || ' outgoing, ' || n_in || ' incoming',
            CASE WHEN n_out > 0 THEN '' END, CASE WHEN n_out > 0 THEN 'Outgoing' END,
            CASE WHEN n_in > 0 THEN '' END, CASE WHEN n_in > 0 THEN 'Incoming' END]) AS line FROM degree)
        WHERE line IS NOT NULL
        UNION ALL
        SELECT source, 9, rel_ord, '  ' || id || '  ' || {short(f'({LABEL})')} || ' (' || typ || ')',
          CASE WHEN resolved_target IS NOT NULL THEN length(id) + 4 END,
          CASE WHEN resolved_target IS NOT NULL THEN length(id) + 4 + length({short(f'({LABEL})')}) END,
          resolved_target FROM rels
        UNION ALL
        SELECT resolved_target, 12, rel_ord, '  ' || id || '  ' || {short('source')} || ' (' || typ || ')',
          length(id) + 4, length(id) + 4 + length({short('source')}), source
        FROM rels WHERE resolved_target IN (SELECT path FROM nodes)"""),
    "package_warnings": pages_query("""SELECT package, '- ' || CASE WHEN length(w) > 56 THEN left(w, 56) || '…' ELSE w END AS line
        FROM (
          SELECT package, 'index: traversal-like archive name was normalized' AS w FROM accepted WHERE unsafe
          UNION ALL SELECT package, 'index: archive path exceeds maximum depth of 64; entry ignored'
          FROM accepted WHERE len(string_split(path, '/')) - 1 > 64
          UNION ALL SELECT package, 'index: archive path collides with ' || chr(39) || archive_name || chr(39) || '; entry ignored'
          FROM fitting WHERE copy > 1)"""),
    "relationship_lines": graph_query(f"""
        SELECT 'sales' AS package, rel_ord, 'outgoing' AS direction, source AS node,
          '  ' || id || '  ' || {short(f'({LABEL})')} || ' (' || typ || ')' AS line,
          CASE WHEN resolved_target IS NOT NULL THEN length(id) + 4 END AS link_start,
          CASE WHEN resolved_target IS NOT NULL THEN length(id) + 4 + length({short(f'({LABEL})')}) END AS link_end,
          resolved_target AS link_target
        FROM rels
        UNION ALL
        SELECT 'sales', rel_ord, 'incoming', resolved_target,
          '  ' || id || '  ' || {short('source')} || ' (' || typ || ')', length(id) + 4,
          length(id) + 4 + length({short('source')}), source
        FROM rels WHERE resolved_target IS NOT NULL"""),
    "target_label": graph_query(f"SELECT source, id, {LABEL} AS label FROM rels"),
    "type_label": f"WITH {LINKS} SELECT package, id, regexp_extract(relationship_type, '[^/]*$') AS label FROM relation",
    "compact_text": f"SELECT doc_id, {short('text')} AS label FROM documents",
    "dangling_relationships": graph_query("""SELECT source, id, resolved_target FROM rels
        WHERE resolved_target IS NOT NULL AND resolved_target NOT IN (SELECT path FROM nodes)"""),
    "dangling_slide_links": f"""WITH {DECKS}
        SELECT package, path AS source, 'img' || unnest(range(1, images + 1)) AS id,
               '/ppt/media/i' || unnest(range(1, images + 1)) || '.png' AS resolved_target FROM slides""",
    "relationship_target_for_id": graph_query("""
        SELECT 'sales' AS package, source, id, arg_min(resolved_target, rel_ord) FILTER (resolved_target IS NOT NULL) AS path
        FROM rels WHERE typ = 'image' GROUP BY source, id"""),
    "relationship_count": graph_query("""SELECT 'sales' AS package, source AS path, count(*) AS n
        FROM rels WHERE typ = 'image' GROUP BY source"""),
    "selection_status": pages_query(f"SELECT package, path, {EXT_LABEL} AS label FROM parts"),
    # Shredding.
    "shred_xml": f"""WITH {BOOKS}, events AS (
          SELECT package, unnest({SHEET_EVENTS}) AS e FROM books),
        numbers AS (SELECT package, k, 18 + k % 6 AS last, unnest(range(1, 19 + k % 6)) AS n FROM books),
        listed AS (
          SELECT package, unnest([0, 1, 5 * last + 2, 5 * last + 3]) AS seq, unnest(['Start', 'Start', 'End', 'End']) AS event,
                 unnest(['worksheet', 'sheetData', 'sheetData', 'worksheet']) AS qname, unnest([0, 1, 1, 0]) AS depth,
                 0 AS n_attrs, NULL AS text FROM (SELECT DISTINCT package, last FROM numbers)
          UNION ALL
          SELECT package, 5 * n - 3 + unnest(range(5)), unnest(['Start', 'Start', 'Text', 'End', 'End']),
                 unnest(['c', 'v', NULL, 'v', 'c']), unnest([2, 3, 4, 3, 2]), unnest([1, 0, 0, 0, 0]),
                 unnest([NULL, NULL, (n * k)::VARCHAR, NULL, NULL]) FROM numbers)
        SELECT package, '/xl/worksheets/sheet1.xml' AS path, e.seq, e.event, e.qname, e.depth, e.n_attrs, e.text FROM events
        UNION ALL SELECT package, '/xl/worksheets/sheet2.xml', seq, event, qname, depth, n_attrs, text FROM listed""",
    "validate_xml": "SELECT 'page-' || page_id AS package, page_id % 13 <> 0 AS valid FROM pages",
    "detect_format": """SELECT 'c' || conv_id || '-' || turn AS package, 'ppt' AS format FROM conversations
        UNION ALL SELECT 'd' || doc_id, 'word' FROM documents
        UNION ALL SELECT 'w' || c_custkey, 'excel' FROM customer""",
    "append_text": f"""WITH {WORDS}
        SELECT package, '/word/document.xml' AS path, string_agg(x || 'skip', '' ORDER BY i) AS text
        FROM lines GROUP BY package""",
    "clean_text": f"SELECT doc_id, {clean('text')} AS text FROM documents",
    # Presentations.
    "slide_order": f"WITH {DECKS} SELECT package, slide_no, path FROM slides",
    "slide_title": f"""WITH {DECKS} SELECT package, path, title FROM slides
        WHERE title IS NOT NULL AND NOT (broken AND i = 1)""",
    "all_text": f"""WITH {DECKS} SELECT package, path, 'noise' || x AS text FROM slides
        WHERE NOT (broken AND i = 1)""",
    "slide_notes": f"WITH {DECKS} SELECT package, slide_no, path, notes_path, notes_text FROM slides",
    "ppt_slides": f"""WITH {DECKS} SELECT package, slide_no, path,
        CASE WHEN broken AND i = 1 THEN '(untitled)' ELSE coalesce(title, '(untitled)') END AS title,
        images, notes_path, notes_text FROM slides""",
    "ppt_summary": f"""WITH {DECKS}, sound AS (SELECT * FROM slides WHERE NOT broken),
        raw AS (
          SELECT DISTINCT package, 0 AS a, unnest([0, 1, 2]) AS b,
                 unnest(['PowerPoint summary', '', 'Slides: ' || n]) AS text, NULL::VARCHAR AS target FROM sound
          UNION ALL
          SELECT package, slide_no, unnest([0, 1, 2, 3, 4]),
                 unnest(['', slide_no || '. ' || coalesce(title, '(untitled)'), '   Part: ' || path,
                   '   Images: ' || images,
                   coalesce('   Notes: ' || notes_path || ' — ' || notes_text, '   Notes: none')]),
                 unnest([NULL, NULL, path, NULL, notes_path]) FROM sound),
        {report('raw', 'a, b')}""",
    "summary_diagnostics": f"""WITH {DECKS}
        SELECT package, 'Error' AS severity, 'summary' AS stage, NULL::VARCHAR AS part,
               'summary parser rejected package XML: /ppt/slides/slide1.xml: malformed XML' AS message
        FROM turns WHERE broken""",
    # Text documents.
    "word_counts": """SELECT 'd' || doc_id AS package, '/word/document.xml' AS path,
        len(string_split(text, chr(10))) AS paragraphs, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS tables
        FROM documents""",
    "heading_outline": f"""WITH {WORDS}
        SELECT package, '/word/document.xml' AS path, ord, level, heading AS text FROM headings""",
    "word_summary": f"""WITH {WORDS}, raw AS (
          SELECT 'd' || doc_id AS package, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS a, 0 AS b,
            unnest(['Word summary', '', 'Document: /word/document.xml',
              'Paragraphs: ' || len(string_split(text, chr(10))),
              'Tables: ' || CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END, 'Images: ' || (doc_id % 3), '',
              'Heading outline']) AS text,
            unnest([NULL, NULL, '/word/document.xml', NULL, NULL, NULL, NULL, NULL]) AS target FROM documents
          UNION ALL SELECT package, 8, ord, '  ' || repeat('  ', level) || heading, NULL FROM headings
          UNION ALL SELECT 'd' || doc_id, 8, 0, '  (none)', NULL FROM documents
            WHERE 'd' || doc_id NOT IN (SELECT package FROM headings)),
        {report('raw', 'a, b')}""",
    # Workbooks.
    "workbook_sheets": f"WITH {BOOKS} SELECT * FROM sheets",
    "shared_strings": f"""WITH {BOOKS} SELECT package, unnest([0, 1]) AS idx,
        unnest([name, segment || ' & co']) AS value FROM books""",
    "worksheet_cells": f"WITH {BOOKS} SELECT * FROM cells",
    "resolve_shared": """SELECT 'book' AS package, '/xl/worksheets/' || l_orderkey || '.xml' AS path,
          'A' || l_linenumber AS reference,
          CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 's' END AS cell_type,
          CASE WHEN l_linenumber % 4 = 0 THEN l_partkey::VARCHAR
               WHEN l_linenumber = 5 THEN l_partkey || 'x'
               WHEN l_linenumber = 6 THEN CASE WHEN l_partkey = 0 THEN p_name ELSE '' END
               ELSE coalesce(p_name, '') END AS value
        FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""",
    "sheet_stats": f"""WITH {BOOKS}
        SELECT package, path, CASE WHEN path LIKE '%sheet1%' THEN 'A1:G1' END AS range,
               count(*) AS n_cells, count(formula) AS formula_count FROM cells GROUP BY package, path""",
    "cell_sample": f"""WITH {BOOKS}
        SELECT package, path, ord, '  ' || reference || ' = ' || coalesce(formula, value) AS line
        FROM cells WHERE ord <= 20 AND coalesce(formula, value) <> ''""",
    "excel_summary": f"""WITH {BOOKS}, sizes AS (
          SELECT package, path, count(*) AS n, count(formula) AS f FROM cells GROUP BY ALL),
        raw AS (
          SELECT package, 0 AS a, unnest([0, 1, 2, 3]) AS b, 0 AS c,
            unnest(['Excel summary', '', 'Workbook: /xl/workbook.xml',
              'Sheets: ' || (SELECT count(*) FROM sheets s WHERE s.package = books.package)]) AS text,
            unnest([NULL, NULL, '/xl/workbook.xml', NULL]) AS target FROM books
          UNION ALL SELECT package, ord, unnest([0, 1]), 0, unnest(['', '- ' || name]), NULL FROM sheets
          UNION ALL SELECT package, ord, 2, 0, '  Worksheet part: unavailable', NULL FROM sheets WHERE path IS NULL
          UNION ALL SELECT s.package, s.ord, unnest([2, 3, 4, 5]), 0,
            unnest(['  Worksheet: ' || s.path, '  Range: ' || CASE WHEN s.ord = 1 THEN 'A1:G1' ELSE 'unknown' END,
              '  Cells: ' || z.n, '  Formulas: ' || z.f]), unnest([s.path, NULL, NULL, NULL])
            FROM sheets s JOIN sizes z ON z.package = s.package AND z.path = s.path
          UNION ALL SELECT s.package, s.ord, 6, c.ord, '  ' || reference || ' = ' || coalesce(formula, value), NULL
            FROM sheets s JOIN cells c ON c.package = s.package AND c.path = s.path
            WHERE c.ord <= 20 AND coalesce(formula, value) <> ''
          UNION ALL SELECT s.package, s.ord, 7, 0, '  ... ' || (z.n - 20) || ' more cells', NULL
            FROM sheets s JOIN sizes z ON z.package = s.package AND z.path = s.path WHERE z.n > 20),
        {report('raw', 'a, b, c')}""",
    "bounded_lines": f"""WITH lines AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
                 unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
        spent AS (
          SELECT *, {SIZE('text')} AS size, CASE WHEN line % 3 = 0 THEN nullif(regexp_extract(text, '^ ?([^ ]+)', 1), '') END AS target,
            coalesce(sum({SIZE('text')} + 1) OVER (PARTITION BY doc_id ORDER BY line
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM lines),
        room AS (SELECT *, greatest(2000 - used - 1, 0) AS room FROM spent WHERE line < 12 AND used < 2000)
        SELECT doc_id::VARCHAR AS package, line,
          CASE WHEN size > room THEN list_max(list_filter(
              list_transform(range(0, length(text) + 1), lambda k: left(text, k)),
              lambda s: octet_length(encode(s)) <= room)) || '…' ELSE text END AS text,
          CASE WHEN target IS NOT NULL THEN strpos(text, target) - 1 END AS link_start,
          CASE WHEN target IS NOT NULL THEN strpos(text, target) - 1 + length(target) END AS link_end,
          target AS link_target
        FROM room""",
    # Previews.
    "preview_kind": f"WITH {DOCS} SELECT package, path, preview_kind FROM kinds",
    **{
        name: f"WITH {DOCS} SELECT path, {name} FROM flags"
        for name in ("is_json", "is_bin", "is_font", "is_media", "is_ole")
    },
    "path_extension": f"WITH {DOCS} SELECT path, {lower('ext')} AS path_extension FROM docs",
    "utf8_text": f"WITH {DOCS} SELECT path, shown AS text FROM docs",
    "is_probably_text": f"""WITH {DOCS} SELECT path,
        NOT regexp_matches(shown, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]') AS is_text FROM docs""",
    "hex_dump": f"WITH {DOCS} SELECT path, line, text FROM dumped",
    "json_pretty": """SELECT event_type AS package, '/events/' || event_id || '.json' AS path,
        CASE WHEN event_id % 5 = 0 THEN props || '}' ELSE
          '{' || chr(10) || '  "a": {' || chr(10) || '    ' || props[2:-2] || chr(10) || '  },' || chr(10)
          || '  "z": []' || chr(10) || '}' END AS text, NULL::VARCHAR AS error FROM events""",
    "xml_pretty": f"""SELECT c_mktsegment AS package, '/customer/' || c_custkey AS path,
        CASE WHEN c_custkey % 6 <> 0 THEN {XML_BODY} END AS text, c_custkey % 6 = 0 AS failed FROM customer""",
    "binary_info": f"WITH {DOCS} SELECT path, info AS text FROM infos",
    "fallback_mime": f"WITH {DOCS} SELECT path, mime FROM kinds",
    "image_guard": f"""SELECT p_brand AS package, '/media/' || p_partkey AS path,
          ['Png', 'Gif', 'Bmp', 'Jpeg'][p_partkey % 4 + 1] AS format, w AS width, h AS height,
          CASE WHEN w IS NULL THEN 'image decode failed: unreadable header'
               WHEN w > 8192 OR h > 8192 THEN 'image decode failed: dimensions exceed the limit'
               WHEN w * h > 16777216 THEN 'image exceeds 16777216 pixel limit' END AS error
        FROM (SELECT *, CASE WHEN p_partkey % 50 <> 7 THEN {_B_W} END AS w,
                     CASE WHEN p_partkey % 50 <> 7 THEN {_B_H} END AS h FROM part)""",
    "limited_output": f"""SELECT doc_id, CASE WHEN {SIZE('text')} > 1000 THEN 'formatted preview exceeds 1000 byte limit' END AS error
        FROM documents""",
    "build_previews": f"""WITH {DOCS}
        SELECT i.package, i.path,
          CASE WHEN preview_kind = 'Image' OR preview_kind = 'Xml' AND contains(i.text, '<') THEN 'Error'
               ELSE preview_kind END AS preview_kind,
          -- Text without any tag is a document that ends before its root.
          CASE WHEN preview_kind = 'Xml' AND contains(i.text, '<') THEN NULL
               WHEN preview_kind = 'Xml' AND doc_id % 9 = 0
               THEN md5('\\xEF\\xBF\\xBD\\x00'::BLOB || encode(i.text))
               WHEN preview_kind IN ('PlainText', 'Json', 'Xml') THEN md5(shown)
               WHEN preview_kind = 'Info' THEN md5(info)
               WHEN preview_kind = 'Hex' THEN md5(coalesce(d.text, '')) END AS digest,
          preview_kind IN ('Image', 'Error') OR preview_kind = 'Xml' AND contains(i.text, '<') AS failed
        FROM infos i LEFT JOIN dumps d ON d.path = i.path AND d.package = i.package""",
    # Requests.
    "latest_wins": """SELECT user_id AS key, event_type AS path, event_id AS request_id FROM events e
        WHERE event_id = (SELECT max(event_id) FROM events m WHERE m.user_id = e.user_id)
          AND event_type = (SELECT arg_max(event_type, event_id) FROM events m
                            WHERE m.user_id = e.user_id AND event_type <> 'error')""",
    "stream_current_results": """SELECT user_id AS key, event_type AS path, event_id AS request_id FROM events e
        WHERE event_id = (SELECT max(event_id) FROM events m WHERE m.user_id = e.user_id)
          AND event_type = (SELECT arg_max(event_type, event_id) FROM events m
                            WHERE m.user_id = e.user_id AND event_type <> 'error')""",
    "versioned_index": """WITH names AS (
          SELECT c_custkey % 4 AS r, 'w' || c_custkey AS package, unnest(['/[Content_Types].xml', '/_rels/.rels', '/xl/workbook.xml',
            '/xl/_rels/workbook.xml.rels', '/xl/sharedStrings.xml', '/xl/worksheets/sheet1.xml', '/xl/worksheets/sheet2.xml']) AS path
          FROM customer)
        SELECT package, path, 'added' AS change, 1 AS version FROM names
        UNION ALL SELECT package, path, CASE WHEN r = 3 THEN 'removed' ELSE 'changed' END, 2 FROM names
        WHERE r = 3 OR r <> 1 AND path = '/xl/sharedStrings.xml'
        UNION ALL SELECT package, path, CASE WHEN r = 3 THEN 'added' ELSE 'changed' END, 3 FROM names
        WHERE r = 3 OR r <> 1 AND path = '/xl/sharedStrings.xml'
        UNION ALL SELECT 'w' || c_custkey, '/new.txt', unnest(['added', 'removed']), unnest([2, 3]) FROM customer WHERE c_custkey % 4 = 1""",
    "bucketed_dangling": graph_query("""SELECT source, id, resolved_target FROM rels
        WHERE resolved_target IS NOT NULL AND resolved_target NOT IN (SELECT path FROM nodes)"""),
    "stream_latest_wins": """SELECT user_id AS key, max(event_id) AS request_id, arg_max(event_type, event_id) AS path
        FROM events GROUP BY user_id""",
}

#: The tables of an index as they were written; two of them are results above.
ORACLES["write_index"] += f"""
        UNION ALL SELECT 'relationships', package, source, id FROM ({ORACLES["parse_relationships"]})
        UNION ALL SELECT 'diagnostics', package, part, message FROM ({ORACLES["diagnostics"]})"""
