import pytest

import __spark_entry__ as entry
from inkweave import catalogue
from tests.oracle import assert_same

#: These yield nothing, or little, on the smallest tables by design.
MAY_BE_EMPTY = {"consistency_loop", "consistency_second_round"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_as_sql(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.ORACLES:
        n = assert_same(df, sf, catalogue.ORACLES[name])
    else:
        n = df.count()
    assert n or name in MAY_BE_EMPTY
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
