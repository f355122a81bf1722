from __future__ import annotations

import pytest

from tessera.plans import registry
from tests.harness import compare, connect

SF = "/root/testdata/sf0.001"
CON = connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, registry.queries()[name], registry.oracle_sql()[name], SF, CON)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert registry.FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())
