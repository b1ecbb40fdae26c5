import os
import shutil

import duckdb
import pytest

import __spark_entry__ as entry
from caselens.plans import registry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


def plain(v):
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*cols).collect())
    cur = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())


def test_entry(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    assert entry.entry(spark).columns[:3] == ["condition", "b", "c"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_of_records(spark, tmp_path):
    from caselens.streaming.running import accuracy_by_window

    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    batch = spark.read.parquet(f"{DATA}/results.parquet")
    (tmp_path / "in").mkdir()
    shutil.copy(f"{DATA}/results.parquet", tmp_path / "in" / "a.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = accuracy_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM running").collect())) == sorted(map(tuple, accuracy_by_window(batch).collect()))
