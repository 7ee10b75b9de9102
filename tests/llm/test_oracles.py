"""Queries with SQL of this part against it, on the smallest tables; SQL's checksum against the library's."""

import zlib

import duckdb
import pytest

from sessionlake.llm import oracles, registry

D = "/root/testdata/sf0.001"


def test_crc_sql():
    got = duckdb.connect().execute(f"SELECT x, {oracles.crc_sql('x')} FROM (VALUES ('0'), ('7'), ('-12'), ('9007199254740993')) t(x)").fetchall()
    assert [c for _, c in got] == [zlib.crc32(x.encode()) for x, _ in got]


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    df = registry.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    plain = lambda row: tuple(round(x, 3) if isinstance(x, float) else x for x in row)
    assert sorted(names) == columns
    assert sorted((plain(r[c] for c in columns) for r in df.collect()), key=str) == sorted((plain(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)
