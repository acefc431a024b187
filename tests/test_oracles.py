import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
# fitted models, checked by their invariants in test_model
SLOW = {"calibrated_scores", "model_comparison"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query_equals_oracle(spark, con, name):
    assert compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name)) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
