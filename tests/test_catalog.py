import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import pytest
from oracle import connect, same_rows

import __spark_entry__ as entry
from tidewell.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
