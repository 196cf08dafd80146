"""Goals taken apart and routed, against goals worked out by hand."""

import pytest
from pyspark.sql import functions as F

from cloakwork.functions.dialect import Spark
from cloakwork.operators import missions

YOUTUBE = "open https://www.youtube.com/results?search_query="
GOALS = [
    ("open amazon and search for iphone 16", "", ["open https://www.amazon.in/s?k=iphone%2016"]),
    ("search tum hi ho on spotify", "", ["open https://open.spotify.com/search/tum%20hi%20ho"]),
    ("play tum hi ho on spotify", "", ["open https://open.spotify.com/search/tum%20hi%20ho", 'play "tum hi ho"']),
    ("open amazon and open cart", "", ["open https://www.amazon.in/gp/cart/view.html"]),
    ("open cart on flipkart", "", ["open https://www.flipkart.com/viewcart"]),
    ("open starbucks and show my cart", "", ["open https://www.starbucks.com", "open cart"]),
    ("buy milk on zepto", "", ["open https://www.zepto.com", 'search for "milk" in zepto and press enter', "open product: milk and add to cart"]),
    ("buy milk on zepto", "https://www.ZEPTO.com/x", ['search for "milk" in zepto and press enter', "open product: milk and add to cart"]),
    ("click the play button on youtube", "", None),
    ("scroll down on amazon", "", None),
    ("click here then open youtube and play lofi", "", [YOUTUBE + "click%20here%20then%20open%20youtube", 'play "click here then open youtube"']),
    ("play despacito", "", [YOUTUBE + "despacito", 'play "despacito"']),
    ("play the song for you", "", [YOUTUBE + "you", 'play "you"']),
    ("play it's my life! (live)", "", [YOUTUBE + "it's%20my%20life!%20(live)", 'play "it\'s my life! (live)"']),
    ("search iphone", "https://www.flipkart.com/", ["open https://www.flipkart.com/search?q=iphone"]),
    ("search iphone", "", None),
    ("find shoes on myntra and select the first result", "", ["open https://www.myntra.com/shoes", "open product: shoes"]),
    ("watch cricket on hotstar", "", ["open https://www.hotstar.com/in/explore?search_query=cricket", 'play "cricket"']),
    ("open gmail", "", None),
    ("search amazon for usb c cable", "", ["open https://www.amazon.in/s?k=usb%20c%20cable"]),
    ("youtube search lofi beats", "", [YOUTUBE + "youtube%20search%20lofi%20beats"]),
    ("order pizza from dominos and buy it", "", ["open https://pizzaonline.dominos.co.in", 'search for "pizza" in dominos and press enter', "open product: pizza and add to cart"]),
    ("open news.site.com and search rain", "", ["open https://news.site.com", 'search for "rain" in news.site.com and press enter']),
    ("please open amazon and search tv", "", ["open https://www.amazon.in/s?k=amazon%20and%20search%20tv"]),
    ("open dropbox and find taxes", "", ["open https://x.com", 'search for "dropbox and find taxes" in x and press enter']),
    ("open the product", "", None),
    ("  ", "", None),
    ("", "", None),
    (None, "", None),
]


def test_goals_on_platforms(spark):
    rows = spark.createDataFrame([(i, t, u) for i, (t, u, _) in enumerate(GOALS)], "i int, text string, url string")
    got = {r["i"]: r["steps"] for r in rows.select("i", F.expr(missions.steps(Spark())).alias("steps")).collect()}
    assert {GOALS[i][:2]: got[i] for i in got} == {(t, u): w for t, u, w in GOALS}


ROUTES = [
    ("page down", "", [("scroll", "down")]), ("next page", "", [("scroll", "down")]), ("scroll to top", "", [("scroll", "top")]), ("my pages", "", [("reason", None)]),
    ("autofill my details", "", [("autofill", None)]), ("fill my form then go back", "", [("autofill", None), ("history", "back")]), ("go forward", "", [("history", "forward")]), ("undo step", "", [("history", "back")]),
    ("open irctc", "", [("navigate", "irctc")]), ("https://a.example/x", "", [("navigate", "https://a.example/x")]), ("view my cart", "https://www.amazon.in/", [("cart", "https://www.amazon.in/gp/cart/view.html")]), ("check my carts", "", [("cart", "cart")]),
    ("show cart", "https://www.ebay.com/cart", [("cart", "cart")]), ("add the red shoes to cart", "", [("product", "add the red shoes")]), ("buy red shoes", "", [("product", "red shoes")]),
    ("play lofi", "", [("navigate", YOUTUBE[5:] + "lofi"), ("media", "lofi")]), ("type hello", "", [("search", "hello")]), ("look for shoes in this tab", "", [("search", "shoes")]), ("press the green button", "", [("click", "green")]), ("click here", "", [("click", None)]),
    ("checkout", "", [("click", "checkout")]), ("order now", "", [("click", "order now")]), ("the refund policy", "", [("deep_search", "the refund policy")]), ("summarise this", "", [("reason", None)]), ("find the notes", "", [("reason", None)]),
]


def test_routes_of_sub_goals(spark):
    rows = [(i, t, u) for i, (t, u, _) in enumerate(ROUTES)]
    spark.createDataFrame(rows, "goal_id int, text string, url string").createOrReplaceTempView("hand_goals")
    got = {}
    for r in spark.sql(missions.routed(Spark(), "hand_goals")).orderBy("goal_id", "pos").collect():
        got.setdefault(r["goal_id"], []).append((r["route"], r["parameter"]))
    assert {ROUTES[i][0]: got[i] for i in got} == {t: w for t, _, w in ROUTES}
