"""The library's queries against DuckDB, and its parts against values worked out by hand."""

import glob
import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cloakwork.functions import checks, js
from cloakwork.operators import attributes, evaluate, redact, resolve
from cloakwork.plans import registry

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return norm(float(v)) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", ["eval_benchmark", "checksums", "detect_email", "detect_aadhaar", "detect_upi", "context_legal", "entities", "search_intent", "nav_target", "split_compound", "page_links", "deep_search", "classify_fields", "plan_offline", "action_safety", "mission_summary", "boxed_entities", "sanitize_elements"])
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(norm(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    assert a == b and a


def test_evaluation_metrics(spark):
    r = evaluate.eval_benchmark(spark, DATA).first()
    assert (r["precision"], r["recall"], r["f1"], r["token_reduction_pct"]) == (0.8571, 1.0, 0.9231, 16.3)


def test_checksums(spark):
    rows = spark.createDataFrame([("432187652109",), ("234567890123",), ("222222222222",), ("4532892144558821",)], "n string")
    got = rows.select(checks.verhoeff(F.col("n")).alias("v"), checks.luhn(F.col("n")).alias("l")).collect()
    assert [r["v"] for r in got] == [True, False, False, False] and got[3]["l"]


def test_boundaries_are_ascii_and_trim_is_unicode(spark):
    r = spark.range(1).select(js.extract(F.lit("éab-1"), r"\b[a-z]+\b", 0).alias("w"), js.trim(F.lit("  x 　")).alias("t")).first()
    assert (r["w"], r["t"]) == ("ab", "x")


def test_firewall_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "mail a.b@example.com, MAIL A.B@EXAMPLE.COM"), (4, "CVV: 392 and 3921"), (5, "pay xy@paytm now"), (6, "pay x@paytm now")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in redact.protect(rows).collect()}
    assert got[1]["redacted"] == got[2]["redacted"] == "" and got[1]["exposure"] == 100
    assert got[3]["redacted"] == "mail [EMAIL_1], MAIL [EMAIL_1]"
    assert got[4]["redacted"] == "CVV: ███ and ███1"
    assert got[5]["gate"]["action"] == "BLOCK"  # the rule's value is the handle, a brand word that stays
    assert got[6]["gate"]["action"] == "PROCEED"  # the rule wants two characters before the handle


def test_gate_fails_closed(spark):
    rows = spark.createDataFrame([(None,), ("x",)], "t string").withColumn("e", F.lit(None).cast("array<struct<category:string,value:string,risk:string>>"))
    assert {r[0]["action"] for r in rows.select(redact.gate(F.col("t"), F.col("e"))).collect()} == {"BLOCK"}


def test_canonical_keys_of_forms_of_one_value(spark):
    rows = spark.createDataFrame([("PHONE", "+91 98765-43210"), ("PHONE", "09876543210"), ("EMAIL", " A@b.Example "), ("ADDRESS", "Delivering to Ghaziabad 201206")], "c string, v string")
    got = [r[0] for r in rows.select(resolve.canonical_key(F.col("c"), F.col("v"))).collect()]
    assert got == ["phone_9876543210", "phone_9876543210", "email_a@b.example", "addr_in_ghaziabad_201206"]


def test_the_rest_needs_no_llm_subpackage():
    for path in glob.glob(os.path.join(os.path.dirname(registry.__file__), "..", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path) as f:
                assert "cloakwork.llm" not in f.read()


@pytest.mark.parametrize("name", ["decompose_goal", "goal_routes", "entity_places", "structural_cards", "search_fields", "media_candidates", "page_plans", "page_safety", "page_autofill", "image_channels", "agent_loop", "utterances", "page_elements", "otp_groups", "leaf_scan", "smart_lookup", "select_option", "plan_client", "plan_payloads", "parse_replies", "plan_requests", "voice_transcripts", "screen_boxes", "mission_log", "page_route", "kv_map", "product_rank"])
def test_page_and_agent_queries_equal_sql(spark, duck, name):
    test_query_equals_sql(spark, duck, name)


def test_payloads_hold_nothing_that_is_found_again(spark):
    """No finding of the page's text is left in what goes out; handles that are brand words block the row."""
    from cloakwork.operators import detect

    rows = registry.QUERIES["plan_payloads"](spark, DATA).collect()
    sent = spark.createDataFrame([(r["page_id"], r["sanitized_text"]) for r in rows if not r["blocked"]], "page_id long, text string")
    left = [f for r in detect.with_findings(sent).collect() for f in r["findings"] if f["category"] in ("EMAIL", "CARD", "PAN", "AADHAAR", "PHONE")]
    assert not left and sum(r["detected"] > 0 and not r["blocked"] for r in rows) > 100
    assert not any("hidden" in r["elements"] or re.search("98765[0-9]{5}", r["elements"]) for r in rows)


def test_pairs_of_a_prompt_as_a_map(spark):
    from cloakwork.operators import goals

    rows = spark.createDataFrame([("set city to Pune, name = Rahul, city to Delhi",), ("nothing",), ("a = b",)], "text string")
    assert [r[0] for r in rows.select(goals.pair_map("text")).collect()] == [{"city": "Delhi", "name": "Rahul"}, {}, {}]


def test_replies_are_unfenced_and_checked(spark):
    from cloakwork.operators import agent

    texts = ['```json\n{"thought":"t","action":"wait"}\n```', '{"thought":"t","action":"fly"}', "oops", None, '```{"thought":"t","action":"scroll","direction":"top","confidence":0.2}```']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(agent.parsed_reply(F.col("t"))).collect()]
    assert [g and (g["action"], g["confidence"]) for g in got] == [("wait", 0.95), None, None, None, ("scroll", 0.2)]


def test_json_files_round_trip(spark, tmp_path):
    from cloakwork.operators import agent

    agent.write_json(spark.createDataFrame([("Asha", 5)], "full_name string, age int"), str(tmp_path / "vault"))
    got = {r["field"]: r["value"] for r in agent.read_vault(spark, str(tmp_path / "vault"), ("full_name", "email")).collect()}
    assert got == {"full_name": "Asha", "email": ""}
    agent.write_json(evaluate.eval_benchmark(spark, DATA), str(tmp_path / "metrics"))
    agent.write_json(evaluate.eval_benchmark(spark, DATA), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 1


def test_attribute_findings_by_hand(spark):
    html = (
        '<h2 class="email">head@example.com</h2><span id="val-email"> a.b@example.com </span><input id="email" value="c@example.com"><b class="CVV">123</b><input id="cvc" value="12"><i class="cvv">CVV</i>'
        '<div id="ship-address">Flat 4, Hill Road\nUpdate location</div><span class="velocity">Fast city</span><p class="address">Select your address</p><u id="glow-ingress-line2">update</u>'
        '<span class="aadhaar">4321 8765 2109</span><span class="aadhaar">4321 8765 2108</span><em class="company">ABCDE 1234 F</em><s id="password">••••</s><p style="border-left:1px">ESOPs of 40</p><p>CTC of 40</p>'
        '<footer><span id="email">foot@example.com</span></footer>'
    )
    rows = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "no tags"), (5, '<b id="phone">98765 43210'), (5, '<b id="phone">98765 43210')], "page_id int, html string")
    got = sorted((r["page_id"], r["category"], r["value"], r["risk"]) for r in attributes.attribute_findings(rows, "page_id").collect())
    assert got == [
        (1, "AADHAAR", "4321 8765 2109", "HIGH"), (1, "ADDRESS", "Flat 4, Hill Road", "MEDIUM"), (1, "CVV", "123", "HIGH"), (1, "EMAIL", "a.b@example.com", "MEDIUM"), (1, "FINANCIAL", "ESOPs of 40", "HIGH"),
        (1, "PAN", "ABCDE 1234 F", "HIGH"), (1, "PASSWORD", "••••", "HIGH"), (5, "PHONE", "98765 43210", "MEDIUM"), (5, "PHONE", "98765 43210", "MEDIUM"),
    ]


def test_link_sections_by_hand(spark, tmp_path):
    html = '<nav><a href="/1">one</a></nav><a href="/2">two</a><header><b>x</b><a href="/3">three</a></header><footer><nav></nav><a href="/4">four</a></footer><a href="/5">five</a>'
    spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "plain")], "page_id int, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r["href"], r["section"]) for r in registry.QUERIES["page_links"](spark, str(tmp_path)).orderBy("page_id", "i").collect()]
    assert got == [("/1", "Navigation Bar"), ("/2", "Main Content"), ("/3", "Page Header"), ("/4", "Page Footer"), ("/5", "Main Content")]
