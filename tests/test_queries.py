"""Every registered query of this part against its SQL, on the smallest tables."""

import duckdb
import pytest

from sessionlake.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "events documents embeddings benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


def plain(row):
    return tuple(round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in row)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = sorted((plain(r[c] for c in columns) for r in df.collect()), key=str)
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted((plain(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)


def test_search_plan_has_no_global_shuffle(spark):
    plan = catalog.QUERIES["fts_message_search"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("SinglePartition") <= 1  # the corpus is one row of sums


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
