"""Every query of the catalogue against its SQL, on the smallest data."""

import pytest

from lexloom import plans
from tests.conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, name):
    same_rows(plans.QUERIES[name](spark, SMALL), plans.ORACLES[name], SMALL)


def test_streams_equal_batches(spark):
    rows = lambda name: sorted(map(str, plans.QUERIES[name](spark, SMALL).select(*sorted(plans.QUERIES[name](spark, SMALL).columns)).collect()))
    assert rows("stream_registry") == rows("registry_state")


def test_entry_file(spark):
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
