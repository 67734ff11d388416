"""Plans stay as they should: no shuffle in row-local work."""

import pytest

from pairloom.plans.catalog import QUERIES
from tests.conftest import SMALL

LOCAL = [
    n for n in QUERIES if n.startswith(("filter_", "script_", "reward_"))
    and n not in ("filter_p90_length", "reward_group_stats", "reward_step_log")  # aggregates
]


@pytest.mark.parametrize("name", LOCAL)
def test_row_local_work_moves_no_rows(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, plan
