"""Queries on the bound graph send no table through the driver: their plans broadcast nothing."""

import pytest

from __spark_entry__ import queries
from codeweave.graph import CodeGraph
from codeweave.plans.binding import Binding
from tests.test_shuffled import SF, planned


@pytest.mark.parametrize("name", ["delete_file", "subgraph", "hot_symbols_calls", "callers", "callers_compact", "callees", "used_by", "uses"])
def test_no_broadcast_in_queries(spark, name):
    plan = planned(queries()[name](spark, SF))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_broadcast_while_it_runs(spark):
    """Joins of tables that turn out small stay shuffled too: the plan that ran, with all of the rows of ``callers``."""
    df = queries()["callers_compact"](spark, SF)
    rows = sorted(r["row"] for r in df.collect())
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in ran and "SortMergeJoin" in ran and "Broadcast" not in ran
    whole = queries()["callers"](spark, SF).collect()
    assert rows and rows == sorted(f"{r.name}\t{r.location}\t{r.confidence}\t@{r.call_line}" for r in whole)


def test_subgraph_of_odd_lists(spark):
    """Names given twice, unknown ones, none, and a null one."""
    g = CodeGraph(Binding(spark, SF).graph())
    rows = lambda names: sorted(map(tuple, g.subgraph(names).collect()))
    once = rows(["blue_bolt"])
    assert [r[1] for r in once if r[0] == "focal"] == ["blue_bolt"] and not [r for r in once if r[0] != "focal" and r[1] == "blue_bolt"]
    assert len(once) > 1 and rows(["blue_bolt", None, "no such name", "blue_bolt"]) == once
    assert rows([]) == rows([None]) == []
