"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from workload.check import compare

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["bucket", "batch_no", "slot", "key"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, sf_dir, name):
    line = compare(spark, oracle, sf_dir, name, QUERIES[name], ORACLES.get(name))
    assert line.startswith("same" if name in ORACLES else "rows"), line
