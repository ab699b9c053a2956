"""Joins of the bound graph shuffle its tables: their files look small, and a broadcast would send their rows through the driver."""

import pytest

from codeweave.operators import traverse
from codeweave.operators.rank import symbol_ranks
from codeweave.plans.binding import Binding

SF = "/root/testdata/sf0.001"


def planned(df):
    """The plan as it is before anything ran; what is measured to be small may still be broadcast later."""
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("table", ["callsites", "bases", "type_refs", "calls", "inherits", "uses", "imports"])
def test_no_broadcast_by_the_size_of_files(spark, table):
    plan = planned(getattr(Binding(spark, SF), table))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_broadcast_of_written_steps(spark, monkeypatch):
    b = Binding(spark, SF)
    calls, starts = b.calls.select("src", "dst"), b.symbols.where("name = 'blue_bolt'")
    plans = []
    for module in (traverse, __import__("codeweave.operators.rank", fromlist=["rank"])):
        def kept(df, write=module.materialize):
            plans.append(planned(df))
            return write(df)

        monkeypatch.setattr(module, "materialize", kept)
    assert traverse.k_hop(calls, starts, 2).count() > 0
    assert symbol_ranks(b.symbols, calls).count() == b.symbols.count()
    assert len(plans) > 20 and not any("BroadcastHashJoin" in p for p in plans)
