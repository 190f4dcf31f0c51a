import pytest

from lodestrata.llm.queries import ORACLES, QUERIES
from tests.compare import both


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, name, sf):
    got, want = both(spark, QUERIES[name], ORACLES[name], f"/root/testdata/{sf}")
    assert got and got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
