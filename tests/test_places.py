"""Where entities, cards, search fields and videos stand, on pages worked out by hand."""

import pytest

from cloakwork.operators import places


def frame(spark, *htmls):
    return spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page_id int, html string")


def test_each_entity_gets_its_place(spark):
    html = """<body><h2>mail head@example.com</h2><p>x <b>mail a.b@example.com</b> y</p><p>phone +91 98765
       43210</p><label>z@example.com</label><div class=badge><i>w@example.com</i></div><footer>foot@example.com</footer><div hidden>no@example.com</div><p>a.b@example.com again</p></body>"""
    got = [(r["page_id"], r["value"], r["place"], r["selector"], r["offset"]) for r in places.entity_places(frame(spark, html, None, "", "mail c@example.com"), "page_id").orderBy("page_id", "pos").collect()]
    assert sorted(got, key=repr) == sorted([
        (0, "head@example.com", "none", None, None), (0, "a.b@example.com", "text", "p:nth-of-type(1) > b", 5), (0, "z@example.com", "none", None, None), (0, "w@example.com", "none", None, None), (0, "foot@example.com", "text", "footer", 0),
        (0, "+91 98765 43210", "leaf", "p:nth-of-type(2)", None), (3, "c@example.com", "text", None, 5),
    ], key=repr)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div><a><img>$1</a></div>", ["$1"]),
        ("<div>Rs. 5<img></div><li>Rs 6<img><a>x</a></li><a>₹7<img></a><a>8<img></a>", ["Rs 6x", "₹7"]),
        ("<section><article>$1<div>$2<img><a>b</a></div></article><article>$3<img><a>c</a></article></section>", ["$1 $2b", "$3c"]),
        ("<span>$1<img><a>x</a></span><div style='display:none'>$1<img><a>x</a></div>", []),
        (None, []),
    ],
)
def test_cards_by_structure(spark, html, want):
    assert [r["text"] for r in places.structural_cards(frame(spark, html), "page_id").orderBy("card").collect()] == want


def test_search_fields_by_rank_and_pass(spark):
    pages = (
        '<input name=q><input type=search id=s>', '<input name=q hidden><input aria-label="Search it" id=a>', "<header><div><input type=text id=h></div></header>", "<nav></nav><input type=text id=t><button title='Search'>go</button>",
        "<form action='/search/x'><p><input type=submit id=no><input id=yes></p></form>", "<input type=hidden name=q><p>none</p>", "<textarea name=q id=g></textarea><input name=q id=later>", None,
    )
    got = {r["page_id"]: (r["pass"], r["selector"], r["opener"]) for r in places.search_fields(frame(spark, *pages), "page_id").collect()}
    assert got == {0: (1, "#s", None), 1: (1, "#a", None), 2: (1, "#h", None), 3: (3, "#t", "button"), 4: (1, "#yes", None), 6: (1, "#g", None)}


def test_videos_once_each_in_order(spark):
    html = "<a href='/watch?v=a1'><img></a><a href='/watch?v=b2&x=1' aria-label='By  label'>1:20</a><a href='/watch?v=a1&t=3'>The title</a><a href='/watch?v=c3'>2:10</a><a href='/watch?v=' title='bare'>x</a><a href='/other?v=d4'>no</a><a hidden href='/watch?v=e5'>hidden</a>"
    got = [(r["pos"], r["watch_key"], r["href"], r["title"]) for r in places.media_candidates(frame(spark, html, None), "page_id").orderBy("pos").collect()]
    assert got == [(0, "a1", "/watch?v=a1", "The title"), (1, "b2", "/watch?v=b2&x=1", "By label"), (2, "/watch?v=", "/watch?v=", "bare")]
