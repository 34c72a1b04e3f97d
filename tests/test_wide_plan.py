"""The long-to-wide plans hash, and unknown code values are refused."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from trialframe.operators import wide
from trialframe.plans import registry

registry.load_all()


@pytest.mark.parametrize("name", ["session_wide_features", "session_wide_onehot", "null_report"])
def test_no_sort_in_long_to_wide(spark, name):
    plan = registry.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan and "HashAggregate" in plan


def test_codes_outside_the_domain(spark):
    rows = [(1, 1, 10, "A"), (1, 2, 20, "B"), (1, 2, 21, "A"), (2, 1, 5, None), (2, 2, 6, "B")]
    df = spark.createDataFrame(rows, "s int, t int, k long, c string")
    got = wide.pivot_first(df, "s", "t", [1, 2, 3], {"k": F.col("k")}, F.col("k"), codes={"c": ("c", ["B", "A"])}).orderBy("session_id").collect()
    assert [tuple(r) for r in got] == [(1, 10, 0, 20, 1, None, None), (2, 5, None, 6, 0, None, None)]
    with pytest.raises(Exception, match="values outside its domain in [12]"):
        wide.pivot_first(df, "s", "t", [1], {}, F.col("k"), codes={"c": ("c", ["A"])}).collect()
    hot = wide.pivot_onehot(df, "s", "t", [1, 2, 3], "c", ["A", "X"], F.col("k")).orderBy("session_id").collect()
    assert [tuple(r) for r in hot] == [(1, 1, 0, 0, 0, None, None), (2, None, None, 0, 0, None, None)]
    assert sorted(tuple(r) for r in wide.missing_trials(df, "s", "t", [1, 3]).collect()) == [(1, 3), (2, 3)]
