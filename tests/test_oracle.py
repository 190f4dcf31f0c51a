import pytest

from lodestrata.plans.registry import ORACLES, QUERIES
from tests.compare import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    got, want = both(spark, QUERIES[name], ORACLES[name], SF)
    assert got and got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
