"""The look-up reads a page once, after pages are dealt out, and its passes decide in order."""

import re

from cloakwork.operators import elements
from cloakwork.plans import forms

DATA = "/root/testdata/sf0.001"


def test_pages_are_folded_once_and_after_they_are_dealt_out(spark):
    plan = forms.smart_lookup(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    steps = re.findall(r"(?m)^\W*(ArrowEvalPython|RepartitionByExpression|Relation)\b", plan)
    assert steps == ["ArrowEvalPython", "RepartitionByExpression", "Relation"] * 2


def test_each_pass_decides_in_its_order(spark):
    html = "<a href=/cart>Basket</a><button name=first>Find blue ring</button><button name=second>Find blue ring now</button><a href=/wares/x9 title=''>Far</a><p>Only <i>words</i></p><a href='/y' hidden>far wares</a><button value='Sent'>Go</button>"
    want = {
        "Cart": ("a:nth-of-type(1)", 0, 0.0), "click on far": ("a:nth-of-type(2)", 1, 0.0), "sent": ("button:nth-of-type(3)", 1, 0.0), "blue ring now": ('button[name="second"]', 2, 0.0), "ring find green": ('button[name="first"]', 3, 66.666667),
        "only words": ("p", 4, 0.0), "wares": ("a:nth-of-type(2)", 5, 0.0), "nothing": None, "!?": None, " ": None,
    }
    rows = spark.createDataFrame([(t, html, t) for t in want] + [("none", None, "far"), ("null", html, None), ("empty", "", "far")], "k string, html string, term string")
    got = {r["k"]: (r["selector"], r["pass"], r["score"]) for r in elements.smart_lookup(rows, "k").collect()}
    assert got == {k: v for k, v in want.items() if v}
