"""The operators that SQL can state, against that SQL."""

import glob
import os

import duckdb
import pytest
from lodestone.llm import queries

DATA = os.environ.get("LODESTONE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sql, name):
    df, want = queries.queries()[name](spark, DATA), sql.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_shards_of_odd_rows(spark, tmp_path):
    """Ties, null ids and texts, repeated rows: shard, slot and checksum as SQL places them."""
    from lodestone.llm import oracles
    from lodestone.llm.sharding import shard_by_bytes

    rows = [(i, f"text {i % 7}" * (i % 5)) for i in range(300)] + [(None, "text 1"), (None, "text 1"), (None, None), (3, None), (5, "ünïcode 𝔘"), (5, "ünïcode 𝔘"), (9, "long " * 5_000), (10, "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, shard int, law string")
    con = duckdb.connect()
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = shard_by_bytes(df)
    want = con.sql(oracles.SQL["op4_sharding"])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
