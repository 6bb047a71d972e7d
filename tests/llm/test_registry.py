"""Queries of the subpackage on the smallest tables."""

import os

import pytest

from threadloom.llm import registry

DATA = os.environ.get("THREADLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

COLUMNS = {
    "p1_found": ["mailbox_id", "name_a", "name_b"],
    "p2_found": ["msg_key", "line_no"],
    "p4_found": ["page_key", "line_no", "kind", "repaired"],
    "p5_found": ["vec_id_a", "vec_id_b"],
    "p6_found": ["chunk_id"],
    "p7_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert name in ("p6_found", "p8_found") or rows
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


def test_oracle_of_splitting(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view email_chunks as select * from '{DATA}/email_chunks.parquet'")
    want = sorted(r[0] for r in c.sql(registry.ORACLES["p6_found"]).fetchall())
    assert sorted(r[0] for r in registry.QUERIES["p6_found"](spark, DATA).collect()) == want
