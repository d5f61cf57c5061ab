"""Secret scans: spans by a plain scan, the ledger's increments, redaction."""

import hashlib
import re
from dataclasses import replace

from packlake.llm import secrets

TEXTS = [
    'x password = "abcdefgh12" y',
    "é token:short api_KEY: 12345678, AKIAABCDEFGHIJKL and AKIASHORT",
    "0123456789abcdef0123456789abcdef0 0123456789abcdef",
    'token="secret"=abcdefghij',
    "",
    None,
    "PASſWORD=abcdefgh1 tokeN=abcdefgh1",
    "secret=" + "0123456789abcdef" * 3,
]
PLAIN = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]


def plain(text):
    out = []
    for number, (kind, pattern, group, least) in enumerate(PLAIN):
        out += [(m.start(), number, m.end(), kind) for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def named(row):
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in row.found)


def versions(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "clash") for k, t in enumerate(texts)], "path long, content string, blob string")


def test_spans(spark):
    rows = versions(spark, TEXTS + TEXTS[:2]).union(spark.createDataFrame([(None, TEXTS[0], ""), (0, TEXTS[2], "")], "path long, content string, blob string"))
    got = secrets.findings(*secrets.update(rows)).collect()
    want = [(k, plain(t)) for k, t in enumerate(TEXTS + TEXTS[:2])] + [(None, plain(TEXTS[0])), (0, plain(TEXTS[2]))]
    assert sorted(((r.path, named(r)) for r in got), key=str) == sorted(want, key=str)
    assert {bytes(r.blob) for r in got} == {hashlib.sha256((t or "").encode()).digest() for t in TEXTS}
    assert secrets.findings(*secrets.update(rows.limit(0))).count() == 0


def test_other_plan_for_many_new_blobs(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BROADCAST_ROWS", 3)
    test_spans(spark)


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    addressed, fresh = secrets.update(versions(spark, TEXTS[:4]))
    assert fresh.count() == 12
    fresh.write.mode("append").parquet(ledger)
    more = versions(spark, TEXTS[2:7], first=100)
    addressed, fresh = secrets.update(more, ledger)
    assert fresh.count() == 6  # the empty text and one more, by three rules
    fresh.write.mode("append").parquet(ledger)
    got = secrets.findings(addressed, secrets.read_ledger(spark, ledger)).collect()
    assert sorted((r.path, named(r)) for r in got) == [(100 + k, plain(t)) for k, t in enumerate(TEXTS[2:7])]
    raised = (secrets.RULES[0], replace(secrets.RULES[1], version=2, pattern=r"AKIA[A-Z0-9]+"), secrets.RULES[2])
    addressed, fresh = secrets.update(versions(spark, TEXTS), ledger, raised)
    assert {(r.kind, r.version) for r in fresh.collect()} == {("access", 2), ("assign", 1), ("hex", 1)}
    assert fresh.where("kind = 'access'").count() == 7 and fresh.count() == 9
    fresh.write.mode("append").parquet(ledger)
    got = secrets.findings(addressed, secrets.read_ledger(spark, ledger), raised).collect()
    assert sorted((r.path, named(r)) for r in got) == [(k, plain(t)) for k, t in enumerate(TEXTS)]
    assert secrets.update(versions(spark, TEXTS), ledger, raised)[1].count() == 0


def test_redact(spark):
    rows = [(k, t, "src", -1) for k, t in enumerate(TEXTS)] + [(None, TEXTS[0], "src", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, n_chars long")
    got = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert len(got) == len(rows)
    assert got[0].text == got[None].text == 'x [SECRET]" y' and got[0].n_chars == 13
    assert got[1].text == "é token:short [SECRET], [SECRET] and AKIASHORT"
    assert got[7].text == "[SECRET]" and got[3].text == TEXTS[3] and got[5].text is None and got[4].n_chars == -1
    assert secrets.redact(docs).columns == docs.columns


def test_more_rules_add_spans(spark):
    texts = [
        "-----BEGIN RSA PRIVATE KEY-----\nMIIB\nabc=\n-----END RSA PRIVATE KEY----- rest",
        "Authorization: Bearer abcdefghijklmnopqrstuvwxyz.1 and bearer short",
        "postgres://user:hunter22@db.example/x https://host/path user@mail",
        'password = "abcdefgh12"',
        "-----BEGIN PRIVATE KEY-----",
    ]
    got = secrets.findings(*secrets.update(versions(spark, texts), rules=secrets.ALL_RULES), rules=secrets.ALL_RULES).collect()
    assert [named(r) for r in sorted(got, key=lambda r: r.path)] == [
        f"key:0:{len(texts[0]) - 5}", "bearer:15:50", "address:0:25", plain(texts[3]), f"key:0:{len(texts[4])}"
    ]


def test_two_increments_are_one_scan(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    rows = versions(spark, TEXTS)
    secrets.update(rows)[1].write.parquet(ledger)
    addressed, new = secrets.update(rows, ledger, rules=secrets.ALL_RULES)
    assert {r.kind for r in new.select("kind").collect()} == {r.kind for r in secrets.MORE_RULES}
    both = secrets.findings(addressed, secrets.read_ledger(spark, ledger).unionByName(new), secrets.ALL_RULES)
    once = secrets.findings(*secrets.update(rows, rules=secrets.ALL_RULES), secrets.ALL_RULES)
    assert sorted((r.path, named(r)) for r in both.collect()) == sorted((r.path, named(r)) for r in once.collect())


def test_long_text(spark):
    text = "words and " * 200_000 + "password=abcdefgh12" + " more" * 200_000
    (row,) = secrets.findings(*secrets.update(versions(spark, [text]))).collect()
    assert named(row) == plain(text) != ""
