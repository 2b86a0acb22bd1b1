"""Every query against its SQL on the smallest tables."""

import glob
import os
import re

import pytest

SF = "/root/testdata/sf0.001"
TABLES = [os.path.basename(p).removesuffix(".parquet") for p in glob.glob(f"{SF}/*.parquet")]

import __spark_entry__  # noqa: E402

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not TABLES, reason="the tables aren't here")
@pytest.mark.parametrize("name", [n for n in sorted(SQL) if not re.match(r"op\d+_", n)])
def test_query(spark, duck, tmp_path, name):
    QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    got = duck.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'").df()
    want = duck.sql(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert key(got) == key(want)


@pytest.mark.skipif(not TABLES, reason="the tables aren't here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)


def test_entry_without_a_library_of_the_training_data_queries(monkeypatch):
    """The other queries stay where an import of the training-data modules fails."""
    import sys

    for name in [m for m in sys.modules if m.startswith(("tidemill.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    left = __spark_entry__.queries()
    assert "scan_parquet" in left and not any(re.match(r"op\d+_", n) for n in left) and set(__spark_entry__.oracle_sql()) <= set(left)
