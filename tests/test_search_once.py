"""Search and token classes look at every entry, and every different token, once."""

from tests.conftest import SF
from wordmill import plans


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_meets_entries_once(spark):
    plan = _plan(plans.QUERIES["named_search"](spark, SF))
    assert plan.count("BroadcastNestedLoopJoin") == 1 and "REPARTITION_BY_NUM" in plan


def test_patterns_meet_tokens_once(spark):
    assert "keys=[w#" in _plan(plans.QUERIES["token_classes"](spark, SF))
