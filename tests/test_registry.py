import pytest
from check_oracle import compare, connect

from __spark_entry__ import entry
from workload.oracle import oracle_sql
from workload.queries import QUERIES


def test_entry_gives_rows(spark):
    frame = entry(spark)
    assert frame.count() > 0 and "DOI" in frame.columns


def test_every_query_has_its_statement():
    assert set(oracle_sql()) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    status, detail = compare(
        spark, connect(sf_dir), name, QUERIES[name], oracle_sql().get(name), sf_dir
    )
    assert status in ("ok", "rows only"), detail
