import os

import duckdb
import pytest

from caselens.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*cols).collect())
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())


def test_every_query_has_its_columns(spark):
    want = {"p1_found": ["plan_id", "category"], "p2_found": ["field_name", "item_key", "page_number", "kind"], "p4_found": ["field_name", "rec_key", "ref_id"]}
    want |= {"p5_ids": ["doc_id", "ids"], "p6_found": ["item_id", "doc_id"], "p7_found": ["doc_id"]}
    for name, columns in want.items():
        assert registry.queries()[name](spark, DATA).columns == columns
