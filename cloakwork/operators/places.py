"""Where on its page each entity stands, and structural finds on page trees: cards and search fields.

All of it works on a page's own row; "inside" is a comparison of intervals of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.functions import checks, js, selectors, tree
from cloakwork.operators import elements, redact

# What never holds an entity, where one is looked for, and what a card and a search field are.
HEADINGS = "h1, h2, h3, h4, h5, h6, [role='heading'], .badge, .card-header"
LABELS = ("h1", "h2", "h3", "h4", "h5", "h6", "label", "th", "thead")
LEAVES = ("p", "span", "div", "td", "th", "li", "strong", "b", "code")
NOT_PLACES = r"\b(?:otp|auth|factor|2fa|verification|code|login)\b"
PRICE = r"[₹$€£]\s*[0-9,]+|\bRs\.?\s*[0-9,]+"
SEARCH_FIELDS = """input[data-testid='search-input'], input[data-testid='SearchBox_Search_Input'], input[data-testid*='search' i], [role='searchbox'], input[type='search'],
    #twotabsearchtextbox, #nav-search-keywords, input[name='field-keywords'], input#search, input.ytd-searchbox, input[name='search_query'], textarea[name='q'], input[name='q'], #searchInput, input[name='search'], input.desktop-searchBar,
    input[placeholder*='Search for Products' i], input[title*='Search for Products' i], input[name='query-builder-test'], input.header-search-input, input[placeholder*='Search GitHub' i],
    input[placeholder*='What do you want to play' i], input[placeholder*='What do you want to listen' i], input[placeholder*='Artists, songs' i], input[placeholder*='Search artists' i], input[placeholder*='Search songs' i], input[placeholder*='Search music' i], input.searchInput,
    input[aria-label*='search' i], textarea[aria-label*='search' i], input[placeholder*='search' i], textarea[placeholder*='search' i], input[placeholder*='find' i], input[id*='search' i], input[name*='search' i], input[class*='search' i], input[name='s'], input[name='k'], input[name='keyword'], input[name='query'],
    form[role='search'] input:not([type='hidden']):not([type='submit']), form[action*='search'] input:not([type='hidden']):not([type='submit']), [role='search'] input:not([type='hidden']):not([type='submit']), header input[type='text'], nav input[type='text']"""
SEARCH_OPENERS = """a[href*='/search'], a[aria-label*='Search' i], button[data-testid='search-tab'], button[aria-label*='Search' i], #search-button-narrow, button.searchTab, button.search-toggle, button.search-button, button[title*='search' i],
    [role='button'][aria-label*='search' i], a[title*='search' i], .header-search-button, button[class*='search' i]"""
ANY_FIELD = "header input:not([type='hidden']), nav input:not([type='hidden']), input[type='text'], textarea"

UNSHOWN = {"unshown": elements.UNSHOWN}
PLACES = tree.spec(UNSHOWN | {"heading": HEADINGS}, ("*",), silent=("unshown",), runs=True)


def entity_places(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, category, value, place, node, selector, offset): where each entity of a page's text stands. The first
    stretch of text that holds its value decides, else the first leaf element, else the first field whose value
    holds it or is held by it; place is then 'none'. Headings, labels and brand words hold no entities, and some
    entities are never placed: their place is 'exempt'. ``pages`` have the keys and ``html``."""
    rows = pages.select(*keys, tree.parsed(F.col("html"), PLACES).alias("page")).withColumn("text", elements.page_text(F.col("page")))
    rows = redact.protect(rows).select(*keys, "page", "entities")
    page = F.col("page")
    nodes = page["nodes"]
    # Every node is of the kind, so a node stands at its own number.
    at = lambda number: F.get(nodes, number)
    barred = lambda n: n["tag"].isin(*LABELS) | PLACES.within(n, "heading")
    branded = lambda n: checks.brand(elements.text_of(page, n))
    usable = lambda n: ~barred(n) & ~branded(n)
    runs = F.transform(F.filter(page["runs"], lambda r: F.coalesce(usable(at(r["node"])), F.lit(True))), lambda r: F.struct(r["node"].alias("node"), F.lower(F.substring(page["text"], r["start"] + 1, r["stop"] - r["start"])).alias("text")))
    leaves = F.transform(F.filter(nodes, lambda n: n["tag"].isin(*LEAVES) & (n["children"] == 0) & (n["stop"] > n["start"]) & ~PLACES.within(n, "unshown") & usable(n)), lambda n: F.struct(n["node"].alias("node"), F.lower(elements.text_of(page, n)).alias("text")))
    fields = F.transform(F.filter(nodes, lambda n: n["tag"].isin("input", "textarea") & ~PLACES.within(n, "unshown")), lambda n: F.struct(n["node"].alias("node"), F.lower(js.trim(elements.value_of(n))).alias("text")))
    rows = rows.withColumns({"runs": runs, "leaves": leaves, "fields": F.filter(fields, lambda f: F.length(f["text"]) >= 3)})
    first = lambda xs, test: F.get(F.filter(xs, test), F.lit(0))

    def placed(e: Column, pos: Column) -> Column:
        value = F.lower(e["value"])
        low = js.trim(value)
        exempt = (e["category"] == "NAME") | (F.length(value) < 2) | checks.brand(e["value"]) | js.matches(low, redact.EXEMPT, True) | ((e["category"] == "ADDRESS") & js.matches(low, NOT_PLACES, True))
        run, leaf = first(F.col("runs"), lambda r: F.contains(r["text"], value)), first(F.col("leaves"), lambda n: F.contains(n["text"], value))
        field = first(F.col("fields"), lambda f: (F.length(value) >= 3) & (F.contains(f["text"], value) | F.contains(value, f["text"])))
        spot = lambda place, x, offset: F.struct(F.lit(place).alias("place"), x["node"].alias("node"), offset.cast("int").alias("offset"))
        found = F.coalesce(F.when(run.isNotNull(), spot("text", run, F.instr(run["text"], value) - 1)), F.when(leaf.isNotNull(), spot("leaf", leaf, F.lit(None))), F.when(field.isNotNull(), spot("field", field, F.lit(None))))
        none = F.struct(F.when(exempt, "exempt").otherwise("none").alias("place"), F.lit(None).cast("int").alias("node"), F.lit(None).cast("int").alias("offset"))
        return F.struct(pos.alias("pos"), e["category"].alias("category"), e["value"].alias("value"), F.when(exempt, none).otherwise(F.coalesce(found, none)).alias("s"))

    spot = F.transform(F.transform("entities", placed), lambda x: x.withField("selector", at(x["s"]["node"])["selector"]))
    return elements.rows_of(rows, spot, *keys).select(*keys, "x.pos", "x.category", "x.value", "x.s.place", "x.s.node", "x.selector", "x.s.offset")


CARDS = tree.spec(UNSHOWN, ("div, article, li, a", "img, a"), silent=("unshown",))


def structural_cards(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, card, selector, text): product cards by their structure: a div, article, list item or link that shows a price and
    holds a picture and a link, or is one. Of cards in one another the outermost stays: nodes come in the order of
    their opening tags, so one pass that remembers the end of the last card taken drops those within it.
    Sizes are unknown and not tested."""
    rows = pages.select(*keys, tree.parsed(F.col("html"), CARDS).alias("page"))
    page = F.col("page")
    nodes = page["nodes"]
    numbers = lambda tag: F.transform(F.filter(nodes, lambda n: n["tag"] == tag), lambda n: n["node"])
    rows = rows.withColumns({"pictures": numbers("img"), "links": numbers("a")})
    inside = lambda those, n: F.exists(those, lambda x: (x > n["node"]) & (x <= n["last"]))
    priced = F.filter(nodes, lambda n: (n["kind"] == 1) & ~CARDS.within(n, "unshown") & js.matches(elements.text_of(page, n), PRICE, True))
    cards = F.filter(priced, lambda n: inside(F.col("pictures"), n) & ((n["tag"] == "a") | inside(F.col("links"), n)))
    slim = F.transform(cards, lambda n: F.struct(n["node"].alias("node"), n["last"].alias("last"), n["selector"].alias("selector"), elements.text_of(page, n).alias("text")))
    kind = "struct<node:int,last:int,selector:string,text:string>"
    start = F.struct(F.lit(-1).alias("end"), F.array().cast(f"array<{kind}>").alias("kept"))
    outer = F.aggregate(slim.cast(f"array<{kind}>"), start, lambda a, n: F.when(n["node"] <= a["end"], a).otherwise(F.struct(n["last"].alias("end"), F.array_append(a["kept"], n).alias("kept"))))["kept"]
    return elements.rows_of(rows, outer, *keys).select(*keys, F.col("pos").alias("card"), "x.selector", "x.text")


_FIELDS, _OPENERS, _ANY = selectors.parse(SEARCH_FIELDS), selectors.parse(SEARCH_OPENERS), selectors.parse(ANY_FIELD)
_AROUND = {f"in{i}": one.within for i, one in enumerate(_FIELDS + _ANY) if one.within}
SEARCH = tree.Spec(tuple({**{"unshown": selectors.parse(elements.UNSHOWN)}, **{k: (v,) for k, v in _AROUND.items()}}.items()), (_FIELDS + _ANY, _OPENERS), (), ("unshown",))


def search_fields(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, pass, rank, node, selector, opener): the search field of each page that has one. Pass 1 takes the first selector
    of the list that finds a shown field; without one, pass 3 takes the page's first other field, and ``opener`` is the
    shown element that a browser would press first to make a field appear. Selectors are compiled to columns."""
    page = tree.parsed(F.col("html"), SEARCH)
    rows = pages.select(*keys, F.filter(page["nodes"], lambda n: ~SEARCH.within(n, "unshown")).alias("nodes"))

    def rank(ways, n: Column, shift: int = 0) -> Column:
        """The place of the first selector that the node meets; null if none."""
        tests = [(i, selectors.column(one, n["tag"], n["attributes"]) & (SEARCH.within(n, f"in{i + shift}") if one.within else F.lit(True))) for i, one in enumerate(ways)]
        return F.coalesce(*(F.when(t, i) for i, t in tests))

    ranked = lambda ways, shift=0: F.array_min(F.filter(F.transform("nodes", lambda n: F.struct(rank(ways, n, shift).alias("rank"), n["node"].alias("node"), n["selector"].alias("selector"))), lambda x: x["rank"].isNotNull()))
    rows = rows.select(*keys, ranked(_FIELDS).alias("field"), ranked(_OPENERS).alias("opener"), F.array_min(F.filter(F.transform("nodes", lambda n: F.struct(n["node"].alias("node"), n["selector"].alias("selector"), rank(_ANY, n, len(_FIELDS)).alias("rank"))), lambda x: x["rank"].isNotNull())).alias("other"))
    chosen = F.when(F.col("field").isNotNull(), F.struct(F.lit(1).alias("pass"), F.col("field.rank").alias("rank"), F.col("field.node").alias("node"), F.col("field.selector").alias("selector"))).when(F.col("other").isNotNull(), F.struct(F.lit(3).alias("pass"), F.lit(None).cast("int").alias("rank"), F.col("other.node").alias("node"), F.col("other.selector").alias("selector")))
    return rows.select(*keys, chosen.alias("c"), F.when(F.col("field").isNull(), F.col("opener.selector")).alias("opener")).where("c is not null").select(*keys, "c.*", "opener")


# Links to videos, their key, and what is no title.
WATCH, WATCH_KEY, DURATION = "a[href*='/watch?v=']", r"[?&]v=([a-zA-Z0-9_-]+)", r"^\d+:\d+(?::\d+)?$"
VIDEOS = tree.spec(UNSHOWN, (WATCH,), silent=("unshown",))


def media_candidates(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, watch_key, href, title): the videos that a page links to, each once, in the order of their first links. The key
    is the address's v parameter, else the address. The title is the first usable one of the video's links: their title, label or
    text, from two characters on and no duration; videos without one are no candidates."""
    page = tree.parsed(F.col("html"), VIDEOS)
    rows = pages.select(*keys, page.alias("page"))
    links = F.filter(F.col("page")["nodes"], lambda n: ~VIDEOS.within(n, "unshown"))

    def read(n: Column) -> Column:
        href = elements.attribute(n, "href")
        spoken = F.array(*(elements.plain(x) for x in (elements.attribute(n, "title"), elements.attribute(n, "aria-label"), elements.text_of(F.col("page"), n))))
        title = F.get(F.filter(spoken, lambda t: (F.length(t) >= 2) & ~t.rlike(DURATION)), F.lit(0))
        return F.struct(n["node"].alias("node"), F.coalesce(js.some(F.regexp_extract(href, WATCH_KEY, 1)), href).alias("watch_key"), href.alias("href"), title.alias("title"))

    each = elements.rows_of(rows, F.transform(links, read), *keys).select(*keys, "x.*")
    first = each.groupBy(*keys, "watch_key").agg(F.min(F.struct("node", "href")).alias("f"), F.min(F.when(F.col("title").isNotNull(), F.struct("node", "title"))).alias("t")).where("t is not null")
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("f.node")) - 1
    return first.select(*keys, pos.alias("pos"), "watch_key", "f.href", "t.title")
