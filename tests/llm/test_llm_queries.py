"""Every query runs over the smallest tables and gives a row for each row it is about."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

from check import TABLES, rows_of  # noqa: E402

from packlake.llm.oracles import ORACLES  # noqa: E402
from packlake.llm.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
ROWS = {"op5_html": "pages", "op6_warc": "pages"} | dict.fromkeys(
    ("op2_decontamination", "op4_packing", "pipeline", "op11_conversations", "op13_hard_negatives")
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, FOLDER)
    rows = found.collect()
    table = ROWS.get(name, "documents")
    if table:
        assert len(rows) == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    else:
        assert rows
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
    if name in ORACLES:
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        cursor = db.execute(ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(found.columns)
        assert rows_of(found.columns, rows) == rows_of(columns, cursor.fetchall())
