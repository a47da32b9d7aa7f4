"""Every query of the engine against its SQL in DuckDB."""

import pytest
from conftest import rows_of

from trilune import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, data, name):
    got = catalog.queries()[name](spark, data)
    if name not in SQL:
        assert len(got.columns) == len(set(got.columns))
        assert got.count() >= 0
        return
    got, want = got.toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
