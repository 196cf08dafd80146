"""Page trees, selectors and what is built on them, against pages worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import selectors, tree
from cloakwork.operators import agent, elements

EVERY = tree.spec({"footer": elements.FOOTER, "code": elements.CODE_AREA}, (elements.INTERACTIVE,), "li, tr, a", ("footer",), True)


def nodes(html, what=EVERY):
    page = tree.fold(html, what)
    return page, {n["node"]: n for n in page["nodes"]}


def shape(html):
    """Tags with what they hold, as nested lists."""
    page, by = nodes(html)
    kids = lambda p: [[n["tag"], *kids(n["node"])] for n in page["nodes"] if n["parent"] == p]
    for n in page["nodes"]:
        below = {m["node"] for m in page["nodes"] if n["node"] < m["node"] <= n["last"]}
        assert below == {m["node"] for m in page["nodes"] if _above(by, m["node"], n["node"])}
    return kids(-1)


def _above(by, node, other):
    while by[node]["parent"] >= 0:
        node = by[node]["parent"]
        if node == other:
            return True
    return False


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div><p>a<p>b<div>c</div></p></div>", [["div", ["p"], ["p"], ["div"]]]),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", [["ul", ["li", ["ul", ["li"], ["li"]]], ["li"]]]),
        ("<table><tr><td>1<td>2<tr><th>3</table>x<b>", [["table", ["tbody", ["tr", ["td"], ["td"]], ["tr", ["th"]]]], ["b"]]),
        ("<select><option>a<option>b<optgroup><option>c</select><i>", [["select", ["option"], ["option"], ["optgroup", ["option"]]], ["i"]]),
        ("<br><img/><input><hr></br><span/><b>in span</b>", [["br"], ["img"], ["input"], ["hr"], ["span", ["b"]]]),
        ("<svg><path/><g><rect/></g></svg><u></u>", [["svg", ["path"], ["g", ["rect"]]], ["u"]]),
        ("<div></span></div></div><p></p>", [["div"], ["p"]]),
        ("<a href=1>x<a href=2>y</a>", [["a"], ["a"]]),
        ("<script>'<b>' + \"</scr\" </SCRIPT ><style>p{}</style><i>", [["script"], ["style"], ["i"]]),
        ("<!-- <b> --><![CDATA[<u>]]><!doctype x><?php <i>?><p>", [["p"]]),
        ("<dl><dt>a<dd>b<dt>c</dl>", [["dl", ["dt"], ["dd"], ["dt"]]]),
        ("<html><head><title>t</title><body><div></body></html><p>late", [["html", ["head", ["title"]], ["body", ["div", ["p"]]]]]),
        ("a < b <1 <p", []),
        ("<td><div></td></div></td>", [["td", ["div"]]]),
        ("", []),
    ],
)
def test_nesting(html, want):
    assert shape(html) == want


def test_attributes_in_all_quotings():
    tags = """<input a="1 > 0" b='x "y"' c=z/w D E = "f" a="2" g='' h=&amp;&lt; i="caf&eacute; &#39;">"""
    (node,) = nodes(tags)[1].values()
    assert dict(node["attributes"]) == {"a": "1 > 0", "b": 'x "y"', "c": "z/w", "d": "", "e": "f", "g": "", "h": "&<", "i": "café '"}


def test_a_tag_that_never_ends_is_none():
    page, by = nodes('<b>x</b><input type=password value="hunter2 <i>y</i>')
    assert [n["tag"] for n in by.values()] == ["b"] and "hunter2" not in page["text"]


def test_places_paths_and_texts():
    page, by = nodes("<body><div class='a b'><div></div><div class='x:y'>A<p>B &amp; <b>C</b></p><a href=1>D</a><a href=2>E</a></div></div><footer><a href=3>F</a></footer><button aria-label='Go &quot;on&quot;'></body>")
    links = [n for n in by.values() if n["kind"]]
    assert [n["selector"] for n in links] == ["div.a > div:nth-of-type(2) > a:nth-of-type(1)", "div.a > div:nth-of-type(2) > a:nth-of-type(2)", "footer > a", 'button[aria-label="Go\\ \\"on\\""]']
    assert [" ".join(page["text"][n["start"] : n["stop"]].split()) for n in links] == ["D", "E", "", ""]
    assert " ".join(page["text"].split()) == "A B & C DE" and [n["areas"] for n in links] == [0, 0, 1, 0]


def test_identifiers_are_escaped():
    assert [tree.escaped(x) for x in ("a_b-c", "1st", "a b", "é.x", "-2", "a:b", "\n")] == ["a_b-c", "\\31 st", "a\\ b", "é\\.x", "-\\32 ", "a\\:b", "\\a "]


def test_the_closest_interval_and_options():
    _, by = nodes("<ul><li><b><i>x</i></b></li></ul><select id=s><option value=1>One<option selected>Two <b>x</b></select>")
    near = {n["tag"]: n["near"] for n in reversed(by.values())}
    assert near["i"] == near["b"] == near["li"] == 1 and near["ul"] == -1
    select = next(n for n in by.values() if n["tag"] == "select")
    assert select["options"] == [{"value": "1", "label": "One", "selected": False}, {"value": "Two x", "label": "Two x", "selected": True}]


def test_deep_and_long_pages_are_linear():
    import time

    began = time.time()
    page, by = nodes("<div>" * 20_000 + "x" + "<p>" * 20_000 + "<a b=" * 5_000)
    assert len(by) == 40_000 and page["text"].strip() == "x" and time.time() - began < 20


@pytest.mark.parametrize("text", [elements.INTERACTIVE, elements.FOOTER, elements.CODE_AREA, elements.NAMED, elements.CODE_CELL, "a[href^='/x' i], a[href$='.PDF'], [class~=k], p:not([hidden]), #i.k", elements.UNSHOWN])
def test_selectors_as_columns_and_in_tasks(spark, text):
    cases = [
        ("a", {"href": "/X/1.PDF"}), ("a", {}), ("input", {"maxlength": "1", "class": "OTP-row k"}), ("input", {"type": "HIDDEN"}), ("p", {"hidden": ""}), ("p", {"id": "i", "class": "a k b"}), ("div", {"class": "footer x", "style": "Display:None"}),
        ("div", {"tabindex": "-1"}), ("div", {"tabindex": "0", "role": "button"}), ("span", {"class": "footers", "id": "verification"}), ("dialog", {}), ("input", {"pattern": "[0-9]*"}), ("b", {"class": ""}), ("footer", {"onclick": ""}),
    ]
    parsed = selectors.parse(text)
    rows = spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(cases)], "i int, t string, a map<string,string>")
    got = {r["i"]: list(r)[1:] for r in rows.select("i", *(selectors.column(s, F.col("t"), F.col("a")).alias(f"c{k}") for k, s in enumerate(parsed))).collect()}
    matcher = selectors.Matcher(tuple((s,) for s in parsed))
    for i, (t, a) in enumerate(cases):
        assert got[i] == [selectors.holds(s, t, a) for s in parsed] == [bool(matcher.bits(t, a) >> k & 1) for k in range(len(parsed))]


def test_selectors_that_are_none():
    for bad in ("a b c", "a > b", "[x", "a::before"):
        with pytest.raises(ValueError):
            selectors.parse(bad)


def test_all_elements_of_a_page_are_asked(spark):
    links = "".join(f"<a href=/{i}>Link {i}</a>" for i in range(90))
    html = f"<body>{links}<ul><li>Alpha <b>beta gamma</b></li></ul><p title='x'>lonely words here</p><button title='Exact title'>Other</button><select><option value=z>Zed</select><div class=otp-row>{'<input class=c value=4>' * 5}</div></body>"
    terms = ["link 77", "beta gamma", "gamma alpha", "lonely words", "exact title", "go to cart", "nothing of it"]
    rows = spark.createDataFrame([(i, html, t) for i, t in enumerate(terms)] + [(99, None, "x"), (98, html, ""), (97, html, None)], "page_id int, html string, term string")
    got = {r["page_id"]: (r["selector"], r["pass"]) for r in elements.smart_lookup(rows, "page_id").collect()}
    assert got == {0: ("a:nth-of-type(78)", 2), 1: ("ul > li", 4), 2: ("ul > li", 4), 3: ("p", 4), 4: ("button", 1)}
    pages = rows.where("page_id in (0, 99)").select("page_id", "html")
    assert [(r["cells"], r["code"]) for r in elements.code_groups(pages, "page_id").collect()] == [(5, "44444")]
    found = elements.elements(pages, "page_id", most=1 << 30)
    assert [tuple(r) for r in elements.chosen_option(found, F.lit("ZED"), "page_id").collect()] == [(0, 91, 0, "z")]
    assert elements.elements(pages, "page_id").count() == 60


PASSWORD, CODE, CARD = "hunter2-Zebra", "4829", "4532 8921 4455 8821"
WAYS = {
    "double": '<input type="password" value="{p}"><div class="otp-box">{c}</div><input name="card" value="{k}">',
    "single": "<input type='password' value='{p}'><div class='otp-box'>{c}</div><input name='card' value='{k}'>",
    "none": "<input type=password value={p}><div class=otp-box>{c}</div><input name=card value='{k}'>",
    "upper": "<INPUT TYPE=PASSWORD VALUE='{p}'><DIV CLASS='OTP-box'>{c}</DIV><INPUT NAME=CARD VALUE='{k}'>",
    "nested": "<section id='verification'><div><div></div></div><p>a<p>b<div><div></div>{c}</div><input value='{p}' type='password'></section><textarea name='card'>{k}</textarea>",
    "unclosed": "<div id=otp><div><span><ul><li>{c}</div></div><form><div><input type = 'password' value = '{p}'><input id=card-no value='{k}'>",
    "leftover": "<dialog></div></span>{c}<input type=password value='{p}'</dialog><label>Card <input value='{k}'></label>",
    "texts": "<div class=otp><input type=password value='{p}' title='your &lt;word&gt;'>{c}</div><p>Card {k}</p><button>Card {k}</button><a href=# title='{k}'>x</a>",
}


def test_no_secret_leaves(spark):
    cells = "".join(f"<input maxlength=1 value={d}>" if i % 2 else f"<input value='{d}' size='1'>" for i, d in enumerate(CODE))
    pages = [(way, f"<html><body><h1>Pay</h1>{html.format(p=PASSWORD, c=cells, k=CARD)}</body></html>") for way, html in WAYS.items()]
    rows = agent.payloads(spark.createDataFrame(pages, "page_id string, html string"), "page_id").collect()
    assert {r["page_id"] for r in rows if not r["blocked"]} == set(WAYS)
    for row in rows:
        sent = json.dumps(json.loads(row["elements"]), ensure_ascii=False) + row["sanitized_text"] + row["preview"]
        assert len(json.loads(row["elements"])) >= 5, row["page_id"]
        assert PASSWORD not in sent and CARD not in sent and CARD.replace(" ", "") not in sent, row["page_id"]
        assert not [e for e in json.loads(row["elements"]) if e["tag"] == "input" and e["text"] in set(CODE)], row["page_id"]


def test_what_would_leave_by_another_way_blocks(spark):
    pages = [
        (1, f"<p>the word is {PASSWORD}</p><input type=password value='{PASSWORD}'>"),
        (2, f"<a href=x id='{PASSWORD}'>y</a><input type=password value='{PASSWORD}'>"),
        (3, "<p>mail a.b@example.com</p><button name='a.b@example.com'>Go</button>"),
        (4, "<button id='sk-abcdefghijklmnopqrstuvwxyz123456'>Go</button>"),
        (5, "<p>fine</p><button>Go</button>"), (6, None), (7, ""),
    ]
    got = {r["page_id"]: r["blocked"] for r in agent.payloads(spark.createDataFrame(pages, "page_id int, html string"), "page_id").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0}


def test_tags_are_read_once_and_nodes_are_few_at_a_time(monkeypatch):
    """Each different tag is read once for all pages of a batch, within a bound, and shared attributes stay apart from their nodes' places."""
    read = []
    monkeypatch.setattr(tree, "attributes_of", lambda text, own=tree.attributes_of: read.append(text) or own(text))
    what = tree.spec({"area": ".in"}, ("a, div",), every=True)
    matcher = what.matcher()
    page = "<div class=in><a href=/x>1</a><a href=/x>2</a></div><a href=/x>3</a>"
    first, second = tree.fold(page, what, matcher), tree.fold(page, what, matcher)
    assert first == second and sorted(read) == [" class=in", " href=/x"]
    assert [(n["nth"], n["areas"], n["selector"]) for n in first["nodes"]] == [(1, 1, "div.in"), (1, 1, "div.in > a:nth-of-type(1)"), (2, 1, "div.in > a:nth-of-type(2)"), (1, 0, "a")]
    monkeypatch.setattr(tree, "TAGS", 1)
    assert tree.fold(page, what) == first


def test_pages_of_several_portions_keep_their_order(spark):
    rows = spark.range(3 * tree.PAGES + 1).selectExpr("id", "concat('<title>', id, '</title><a>', id) as html").coalesce(1)
    got = rows.select("id", tree.parsed(F.col("html"), tree.spec(kinds=("a",))).alias("p")).selectExpr("count(*) n", "count_if(p.title = string(id) and size(p.nodes) = 1 and p.text = string(id)) m").first()
    assert tuple(got) == (3 * tree.PAGES + 1,) * 2
