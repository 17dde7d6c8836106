"""Every query of the subpackage runs on the smallest tables; SQL agrees where there is some."""

import os

import duckdb
import pytest

from strataloom.llm import queries, sql

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
COLUMNS = {
    "p1_found": ["query_id", "code_unit_id"], "p2_found": ["code_unit_id", "line_no"], "p3_found": ["file_id"], "p5_found": ["code_unit_id"],
    "p6_found": ["file_id"], "p7_found": ["code_unit_id_a", "code_unit_id_b"], "p9_found": ["doc_id", "item_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(rows)) == len(rows)
    if name in sql.oracle_sql():
        con = duckdb.connect()
        for t in os.listdir(FOLDER):
            con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{t}')")
        found = con.execute(sql.oracle_sql()[name])
        names = [c[0] for c in found.description]
        want = sorted(tuple(str(v) for _, v in sorted(zip(names, r))) for r in found.fetchall())
        assert want == sorted(tuple(str(v) for _, v in sorted(r.asDict().items())) for r in rows)
