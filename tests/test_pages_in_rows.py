"""Pages are folded without rests of the collector, and what is asked of a page stays in its row."""

import gc

import pyarrow as pa

from cloakwork.functions import tree
from cloakwork.plans import acting

DATA = "/root/testdata/sf0.001"


def test_the_collector_rests_while_pages_are_folded(monkeypatch):
    what, seen, fold = tree.spec({}, ("p",)), [], tree.fold
    monkeypatch.setattr(tree.F, "arrow_udf", lambda pages, _: lambda _: pages)
    monkeypatch.setattr(tree, "fold", lambda *a: seen.append(gc.isenabled()) or fold(*a))
    out = tree.parsed(None, what)(pa.array(["<p>a<P title='x>y'>b", None, "<div a=b >c</div >"]))
    assert seen == [False] * 3 and gc.isenabled()
    assert [[(n["tag"], n["attributes"]) for n in p["nodes"]] for p in out.to_pylist()] == [[("p", []), ("p", [("title", "x>y")])], [], []]


def test_page_safety_joins_nothing(spark):
    plan = acting.page_safety(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
