"""Every query that has SQL gives the SQL's rows on the smallest tables."""

from pathlib import Path

import pytest
from checks import connection, rows

import __spark_entry__ as entry_module
from sievework.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    got = entry_module.entry(spark)
    assert set(got.columns) == {"doc_id", "item_id", "reason", "shared"}
    got.collect()
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_every_query_takes_empty_tables(spark, tmp_path):
    for f in Path(DATA).glob("*.parquet"):
        spark.read.parquet(str(f)).limit(0).coalesce(1).write.parquet(f"{tmp_path}/{f.name}")
    for name, query in catalog.QUERIES.items():
        if "stream" not in name:  # a stream needs files to come from
            query(spark, str(tmp_path)).collect()
