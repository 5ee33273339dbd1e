"""Every core query against its SQL twin on the smallest tables; those without one must run."""

import pytest

from quillmill.plans import registry
from tests.oracle import compare

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    if name in registry.ORACLES:
        assert compare(spark, SF, registry.QUERIES[name], registry.ORACLES[name]) == ""
    else:
        df = registry.QUERIES[name](spark, SF)
        assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
