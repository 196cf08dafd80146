"""Interactive elements of pages, and what is found, chosen and planned on them.

A page is read as a tree once (``functions/tree.py``); elements are the tree's nodes that meet selectors, numbered
by their places in the row's array, so nothing is shuffled. Layout is unknown: what no attribute
and no inline style hides counts as visible.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.functions import checks, js, selectors, tree
from cloakwork.operators.rules import NOT_ADDRESS, RULES
from cloakwork.sources.pages import ELEMENTS, LABEL_MOST, SENSITIVE_NAME, SENSITIVE_VALUES

# What is interactive, what a look-up drops, and what a plan reacts to.
INTERACTIVE = """button, a[href], input, textarea, select, [role="button"], [role="link"], [role="checkbox"], [role="tab"], [role="menuitem"], [role="searchbox"], [role="combobox"], [role="switch"], [role="option"], [onclick], [data-action], [tabindex]:not([tabindex="-1"])"""
POINTED = ", ".join(f"{t}[style*='cursor:{gap}pointer' i]" for t in ("div", "span", "li", "summary", "label") for gap in ("", " "))
FOOTER = "footer, #navFooter, .navFooterLine, [role='contentinfo'], .footer, #footer"
CODE_AREA = ".otp-inputs, .otp-container, [class*='otp' i], [id*='otp' i], [class*='verification' i], [id*='verification' i], dialog, [role='dialog'], .modal"
CODE_ROW = "[class*='otp-row' i], [id*='otp-row' i], [class*='otp-input' i], [class*='code-inputs' i]"
CODE_CELL = "input[maxlength='1'], input[size='1'], input[pattern*='0-9']"
UNSHOWN = "[hidden], [style*='display:none' i], [style*='display: none' i], [style*='visibility:hidden' i], [style*='visibility: hidden' i], input[type='hidden' i]"
NAMED = "button, a, input[type='button'], input[type='submit'], [role='button'], [role='tab'], [role='link'], [role='menuitem'], [onclick], .btn, select, label, summary, [tabindex]"
TEXTS = "h1, h2, h3, h4, h5, h6, strong, b, span, p, div, li, td, tr, [data-testid], [data-component-type]"
AROUND = "button, a, [role='button'], [role='tab'], [role='link'], [onclick], .btn, label, li, tr"
CANDIDATES, TEXT_CHILDREN, TEXT_LONGEST = 80, 6, 120
HIDDEN = r"(?is)<(script|style|footer)\b[^>]*>.*?</\1\s*>"
CARD_BRANDS = r"^(?:4\d{15}|5[1-5]\d{14}|3[47]\d{13}|6(?:011|5\d{2})\d{12})$"
LEAF = r"(?i)<(?:div|span|p|td|b|strong|code)\b[^>]*>([^<>]*)</"
NO_ADDRESS = r"^(?:update|change|select|choose|enter|set|add|manage|view|edit|see|your)\s+(?:location|address|pincode|zipcode|city|delivery|destination)$"
LOOKUP_VERBS = r"\b(?:click|tap|press|select|open|go\s+to)\s+(?:on\s+)?"
LOOKUP_NOUNS = r"\b(?:button|btn|link|tab|icon|card|page|waale|wale|kro|karo|pe)\b"
LOOKUP_STOP = ("the", "and", "for", "with", "this", "that")
CART_TERMS = ("cart", "go to cart", "open cart")
BACK = r"\b(?:go\s*back|navigate\s*back|take\s*me\s*back|back|previous\s*page|go\s*to\s*previous\s*page|previous\s*step|return\s*to\s*previous|undo(?:\s*step)?)\b"
FORWARD = r"\b(?:go\s*forward|navigate\s*forward|forward|next\s*page|go\s*to\s*next\s*page)\b"
FILL = r"\b(?:auto\s*fill|fill\s*(?:my\s*)?(?:details|form|data|credentials|address|kyc|info)|populate\s*form)\b"
SCROLL = r"\b(?:scroll|page)\s*(?:down|up|to\s+top|to\s+bottom|top|bottom)?\b"
PRESS = r"\b(?:press|hit)\s+(?:enter|tab|escape|esc|backspace)\b"
ORDERS = "recent orders|orders|track package|track delivery"
PLAN_WORDS = r"\b(?:click|tap|press|select|open|go\s+to|button|btn|link|tab|card|the|on|kro|karo|pe|waale|wale)\b"
PROMPT_MOST = 120
PLAN_STOP = ("for", "and", "with", "this", "that")


AREAS = {"footer": FOOTER, "code": CODE_AREA, "unshown": UNSHOWN}
PAGE = tree.spec(AREAS, (INTERACTIVE, POINTED), silent=("footer", "unshown"))
LOOKUP = tree.spec({"unshown": UNSHOWN}, (NAMED, TEXTS), closest=AROUND)
CODES = tree.spec({"row": CODE_ROW, "unshown": UNSHOWN, "footer": FOOTER}, ("input", CODE_ROW), paths=False)


def plain(text: Column) -> Column:
    """A text on one line."""
    return js.trim(js.replace(text, r"\s+", " "))


def attribute(node: Column, name: str) -> Column:
    """An attribute's value; empty without it."""
    return F.coalesce(node["attributes"][name], F.lit(""))


def text_of(page: Column, node: Column) -> Column:
    return plain(F.substring(page["text"], node["start"] + 1, node["stop"] - node["start"]))


def value_of(node: Column) -> Column:
    """A field's value: what is set, a text area's content, or a select's chosen option, else its first one."""
    chosen = F.coalesce(F.get(F.filter(node["options"], lambda o: o["selected"]), F.lit(0)), F.get(node["options"], F.lit(0)))
    ticked = (node["tag"] == "input") & F.lower(attribute(node, "type")).isin("checkbox", "radio") & node["attributes"]["value"].isNull()
    return F.when(node["tag"] == "textarea", F.coalesce(node["content"], F.lit(""))).when(node["tag"] == "select", F.coalesce(chosen["value"], F.lit(""))).when(ticked, "on").otherwise(F.when(node["tag"].isin("input", "button"), attribute(node, "value")).otherwise(""))


def page_text(page: Column) -> Column:
    """The text of a page parsed with PAGE, without its footer and what isn't shown."""
    return plain(page["text"])


def rows_of(parsed: DataFrame, array: Column, *keys: str) -> DataFrame:
    """(keys, pos, x): a row for each item of an array. The outer form and a filter after it: of the plain one the optimizer
    infers a filter on the array's size, for which the whole array would be made once more."""
    return parsed.select(*keys, F.posexplode_outer(array).alias("pos", "x")).where("x is not null")


def with_tree(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, page): the pages as trees."""
    return pages.select(*keys, tree.parsed(F.col("html"), PAGE).alias("page"))


def elements(pages: DataFrame, *keys: str, most: int = ELEMENTS) -> DataFrame:
    """A page's first interactive elements outside of its footer: label, attributes, selector and
    sensitivity. ``pages`` has the keys and ``html``. Elements known by a pointer alone follow the others, as long as there
    are under 80 candidates."""
    return of_tree(with_tree(pages, *keys), *keys, most=most)


def element_array(page: Column, most: int = ELEMENTS) -> Column:
    """The elements of a page parsed with PAGE, in order, as structs."""
    inside = lambda n, area: PAGE.within(n, area)
    first = F.filter(page["nodes"], lambda n: n["kind"] == 1)
    pointed = F.filter(page["nodes"], lambda n: (n["kind"] == 2) & ~inside(n, "footer") & ((n["children"] == 0) | ((n["children"] == 1) & n["pictured"])))
    candidates = F.concat(first, F.slice(pointed, F.lit(1), F.greatest(F.lit(0), F.lit(CANDIDATES) - F.size(first))))
    kept = F.slice(F.filter(candidates, lambda n: ~inside(n, "footer") & ~inside(n, "unshown")), 1, most)

    def read(n: Column, idx: Column) -> Column:
        own = {"idx": idx, "node": n["node"], "tag": n["tag"], "type": F.lower(attribute(n, "type")), "value": value_of(n), "inner": F.when(n["tag"] == "textarea", "").otherwise(text_of(page, n)), "selector": n["selector"], "options": n["options"], "in_code": inside(n, "code")}
        own |= {k: attribute(n, a) for k, a in (("name", "name"), ("id", "id"), ("placeholder", "placeholder"), ("role", "role"), ("href", "href"), ("class", "class"))}
        own |= {"aria": F.coalesce(js.some(attribute(n, "aria-label")), attribute(n, "title")), "drawn": F.coalesce(js.some(n["drawing"]), n["image"], F.lit("")), "lone": (attribute(n, "maxlength") == "1") | (attribute(n, "size") == "1")}
        return F.struct(*(c.alias(k) for k, c in own.items()))

    def shown(e: Column) -> Column:
        text = F.when(e["tag"].isin("input", "textarea") & (e["value"] != "") & (e["type"] != "password"), e["value"]).otherwise(e["inner"])
        return e.withField("text", F.coalesce(js.some(text), e["drawn"])).withField("is_cell", (e["tag"] == "input") & e["lone"] & e["in_code"])

    def judged(e: Column) -> Column:
        tests = [js.matches(e[c], SENSITIVE_NAME, True) for c in ("name", "id", "placeholder", "aria")] + [js.matches(F.coalesce(js.some(e["value"]), e["text"]), p) for p in SENSITIVE_VALUES]
        return e.withField("is_sensitive", reduce(Column.__or__, tests, e["type"].isin("password", "email", "tel") | e["is_cell"]))

    return F.transform(F.transform(F.transform(kept, read), shown), judged)


COLUMNS = ("idx", "node", "tag", "text", "aria", "placeholder", "type", "id", "name", "href", "role", "class", "value", "selector", "is_cell", "is_sensitive", "options")


def of_tree(parsed: DataFrame, *keys: str, most: int = ELEMENTS) -> DataFrame:
    """The elements of pages that are parsed already."""
    return rows_of(parsed, element_array(F.col("page"), most), *keys).select(*keys, *(F.col("x")[c].alias(c) for c in COLUMNS))


def prompt_lines(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, line): what a prompt says of a page's first 120 elements, inputs and buttons first, 60
    lines at most."""
    label = F.coalesce(*(js.some(F.col(c)) for c in ("text", "aria", "placeholder", "id", "name")), F.lit("(unlabeled)"))
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] <"), F.col("tag"), F.lit("> '"), F.substring(js.trim(label), 1, LABEL_MOST), F.lit("' (selector: "), F.col("selector"), F.lit(")"))
    late = ~F.col("tag").isin("button", "input", "select") & ~F.contains(F.lower("selector"), F.lit("btn"))
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(late, "idx"))
    return found.where(F.col("idx") < PROMPT_MOST).select(*keys, pos.alias("pos"), line.alias("line")).where(F.col("pos") <= ELEMENTS)


def code_groups(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, cells, code): pages with 4 to 8 inputs of one character, wherever they stand; on others, areas for a code
    that hold 4 to 8 inputs, one after the other. An empty cell shows a dot."""
    shown = lambda n: F.coalesce(js.some(js.trim(attribute(n, "value"))), F.lit("•"))
    nodes = tree.parsed(F.col("html"), CODES)["nodes"]
    rows = pages.select(*keys, nodes.alias("nodes"))
    usable = lambda n: ~CODES.within(n, "unshown") & ~CODES.within(n, "footer")
    meets = lambda n, text: reduce(Column.__or__, [selectors.column(s, n["tag"], n["attributes"]) for s in selectors.parse(text)])
    single = F.filter("nodes", lambda n: meets(n, CODE_CELL))
    rows = rows.withColumn("single", single)
    areas = F.transform(F.filter("nodes", lambda a: meets(a, CODE_ROW)), lambda a: F.filter("nodes", lambda n: (n["tag"] == "input") & (n["node"] > a["node"]) & (n["node"] <= a["last"])))
    one = F.size("single").between(4, 8)
    groups = F.when(one, F.array("single")).otherwise(F.filter(F.when(F.exists("nodes", lambda n: CODES.within(n, "row")), areas).otherwise(F.array()), lambda g: F.size(g).between(4, 8)))
    rows = rows_of(rows, F.transform(groups, lambda g: F.filter(g, usable)), *keys).select(*keys, F.col("x").alias("g")).where(F.size("g") > 0)
    return rows.select(*keys, F.size("g").alias("cells"), F.array_join(F.transform("g", shown), "").alias("code"))


def leaf_findings(pages: DataFrame, *keys: str) -> DataFrame:
    """The first card, Aadhaar number, PAN and place of each leaf text of 8 to 80 characters."""
    rule = {r.name: r for r in RULES}
    leaf = F.transform(F.regexp_extract_all(F.regexp_replace("html", HIDDEN, ""), F.lit(LEAF), F.lit(1)), js.trim)
    rows = pages.select(*keys, F.posexplode(leaf).alias("pos", "leaf")).where(F.length("leaf").between(8, 80))
    text = F.col("leaf")
    card = js.extract(text, rule["card"].pattern)
    number = js.digits(card)
    card_ok = F.length(number).between(13, 19) & (checks.luhn(number) | number.rlike(CARD_BRANDS))
    uid = js.extract(text, r"\b[2-9]\d{3}[-\s]?\d{4}[-\s]?\d{4}\b")
    place = F.coalesce(js.some(js.extract(text, rule["address_deliver"].pattern, 1, True)), js.extract(text, r"\b([A-Z][a-zA-Z\s]{2,20}\s+\b[1-9][0-9]{5}\b)", 1))
    low = F.lower(js.trim(place))
    place_ok = (place != "") & ~js.matches(low, NO_ADDRESS, True) & ~js.matches(low, NOT_ADDRESS, True) & ~checks.brand(place)
    found = (("CARD", card, card_ok, "HIGH"), ("AADHAAR", uid, checks.verhoeff(uid), "HIGH"), ("PAN", js.extract(text, rule["pan"].pattern), None, "HIGH"), ("ADDRESS", js.trim(place), place_ok, "MEDIUM"))
    each = F.array(*(F.when((v != "") & (F.lit(True) if ok is None else ok), F.struct(F.lit(c).alias("category"), v.alias("value"), F.lit(risk).alias("risk"))) for c, v, ok, risk in found))
    return rows.select(*keys, "pos", F.explode(F.array_compact(each)).alias("f")).select(*keys, "pos", "f.category", "f.value", "f.risk")


def smart_lookup(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, node, selector, pass, score): the element that a term names. ``rows`` have the keys, ``html`` and ``term``. The
    first pass that finds one decides: the cart, the same text, a part of it, most words, a text and the closest
    element around it that can be used, then id, name or address. All elements of the page are asked, each
    pass over the row's own array."""
    raw = js.trim(F.col("term"))
    clean = js.replace(js.replace(js.replace(raw, "^[\"']|[\"']$", ""), LOOKUP_VERBS, "", True), LOOKUP_NOUNS, "", True)
    clean = F.lower(js.trim(js.replace(clean, r"\s+", " ")))
    clean = F.coalesce(js.some(clean), F.lower(raw))
    words = F.filter(F.transform(F.split(F.col("clean"), r"[\s,_\-—/|]+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: (F.length(w) >= 2) & ~w.isin(*LOOKUP_STOP))
    asked = rows.where(raw != "").select(*keys, F.lower(raw).alias("asked"), clean.alias("clean"), tree.parsed(F.col("html"), LOOKUP).alias("page")).withColumn("words", words)
    low = lambda x: F.lower(js.trim(x))

    def facts(n: Column) -> Column:
        own = {"text": F.lower(text_of(F.col("page"), n)), "val": low(value_of(n)), **{k: low(attribute(n, a)) for k, a in (("aria", "aria-label"), ("title", "title"), ("id", "id"), ("name", "name"), ("href", "href"))}}
        return F.struct(n["node"].alias("node"), n["near"].alias("near"), n["tag"].alias("tag"), n["kind"].alias("kind"), n["children"].alias("children"), n["selector"].alias("selector"), *(c.alias(k) for k, c in own.items()), (n["attributes"]["data-testid"].isNotNull() | n["attributes"]["data-component-type"].isNotNull()).alias("marked"))

    seen = F.transform(F.filter(F.col("page")["nodes"], lambda n: ~LOOKUP.within(n, "unshown")), facts)
    asked = asked.select(*keys, "asked", "clean", "words", F.split("clean", r"\s+").alias("parts"), seen.alias("seen")).withColumn("named", F.filter("seen", lambda x: x["kind"] == 1))
    c, ws, first = F.col("clean"), F.col("words"), lambda found: F.get(found, F.lit(0))
    chosen = lambda k, x, score=None: F.struct(F.lit(k).alias("pass"), x["node"].alias("node"), x["selector"].alias("selector"), (F.lit(0.0) if score is None else score).alias("score"))
    of = lambda k, found: first(F.transform(found, lambda x: chosen(k, x)))
    cart = F.col("asked").isin(*CART_TERMS)
    carts = F.filter("named", lambda x: x["id"].isin("nav-cart", "btn-nav-cart") | ((x["tag"] == "a") & F.contains(x["href"], F.lit("cart"))) | ((x["tag"] == "button") & F.contains(x["id"], F.lit("cart"))))
    same = F.filter("named", lambda x: (x["text"] == c) | (x["aria"] == c) | (x["title"] == c) | (x["val"] == c))
    part = lambda x: (x != "") & (F.contains(x, c) | ((F.length(x) >= 4) & F.array_contains("parts", x)))
    within = F.filter("named", lambda x: part(x["text"]) | part(x["aria"]) | ((x["title"] != "") & F.contains(x["title"], c)) | ((x["val"] != "") & F.contains(x["val"], c)))
    joined = F.transform("named", lambda x: F.struct(F.concat_ws(" ", x["text"], x["aria"], x["title"], x["val"], x["id"], x["name"]).alias("all"), x["node"].alias("node"), x["selector"].alias("selector")))
    hits = F.transform(joined, lambda j: F.struct(F.size(F.filter(ws, lambda w: F.contains(j["all"], w))).alias("hits"), F.when(F.length(j["all"]) > 150, 20).otherwise(0).alias("less"), j["node"].alias("node"), j["selector"].alias("selector")))
    scored = F.transform(F.filter(hits, lambda h: h["hits"] > 0), lambda h: F.struct((h["hits"] * 100.0 / F.size(ws) - h["less"]).alias("score"), (-h["node"]).alias("at"), h["node"].alias("node"), h["selector"].alias("selector")))
    best = F.array_compact(F.array(F.array_max(F.filter(scored, lambda s: s["score"] >= 35))))
    texts = F.filter("seen", lambda x: ((x["kind"] == 2) | x["tag"].isin("strong", "b", "span", "p", "div", "li", "td", "tr") | x["marked"]) & (x["children"] <= TEXT_CHILDREN) & ((x["text"] != "") | (x["aria"] != "")) & ((x["text"] == c) | (x["aria"] == c) | ((F.length(x["text"]) < TEXT_LONGEST) & F.contains(x["text"], c)) | ((F.size(ws) >= 2) & F.forall(ws, lambda w: F.contains(x["text"], w)))))
    around = first(F.transform(F.slice(texts, 1, 1), lambda t: F.coalesce(of(4, F.filter("seen", lambda x: x["node"] == t["near"])), chosen(4, t))))
    anywhere = F.filter("named", lambda x: F.exists(ws, lambda w: F.contains(x["id"], w) | F.contains(x["name"], w) | F.contains(x["href"], w)))
    steps = F.coalesce(F.when(cart, of(0, carts)), of(1, same), of(2, within), first(F.transform(best, lambda s: chosen(3, s, F.round(s["score"], 6)))), around, of(5, anywhere))
    # A filter on the step itself would be pushed below all of this: the pages would be folded twice, once before they are dealt out.
    return rows_of(asked, F.array(steps), *keys).select(*keys, "x.node", "x.selector", "x.pass", "x.score")


def chosen_option(found: DataFrame, wanted: Column, *keys: str) -> DataFrame:
    """(keys, idx, option, value): the first option of each select whose value is the wanted one or
    whose text contains it, in any case. ``found`` has the elements and what ``wanted`` reads."""
    w = F.lower(js.trim(wanted))
    fits = F.transform("options", lambda o: (F.lower(o["value"]) == w) | F.contains(F.lower(o["label"]), w))
    rows = found.where("tag = 'select'").withColumn("option", F.array_position(fits, F.lit(True)).cast("int") - 1)
    return rows.where("option >= 0").select(*keys, "idx", "option", F.get("options", F.col("option"))["value"].alias("value"))


def plan_client(goals: DataFrame, found: DataFrame, navigation: str, query: str, *keys: str) -> DataFrame:
    """(keys, action, value, idx): one action for each goal (keys, goal, and the columns ``navigation`` and
    ``query``) over the elements of its page, by fixed precedence."""
    goal = F.col("goal")
    clean = F.lower(js.trim(js.replace(goal, PLAN_WORDS, " ", True)))
    words = F.filter(F.split(clean, r"\s+"), lambda w: (F.length(w) >= 2) & ~w.isin(*PLAN_STOP))
    rows = goals.withColumns({"words": words, "low": F.lower("goal")})
    digits = F.filter("words", lambda w: w.rlike("[0-9]"))
    joined = rows.join(found.select(*keys, "idx", "tag", "text", "aria", "id", "name", "placeholder"), list(keys), "left")
    label = F.concat_ws(" ", "text", "aria", "id")
    order = F.contains("low", F.lit("order")) & js.matches(label, ORDERS, True)
    search = F.col("low").rlike("search|type|find") & (F.col("tag") == "input") & js.matches(F.concat_ws(" ", "id", "name", "placeholder"), "search|input|query|text|q", True)
    combined = F.lower(F.concat_ws(" ", "text", "aria", "id", "name"))
    missing = F.exists(digits, lambda w: ~F.rlike(combined, F.concat(F.lit("(?<![a-z0-9])"), js.literal(w), F.lit("(?![a-z0-9])"))))
    score = F.when(missing | (F.size("words") == 0), 0.0).otherwise(F.size(F.filter("words", lambda w: F.contains(combined, w))) * 100.0 / F.size("words"))
    joined = joined.withColumns({"order": order, "search": search, "score": score})
    first = lambda test: F.min(F.when(test, F.col("idx")))
    best = F.max(F.when(F.col("score") >= 50, F.struct("score", (-F.col("idx")).alias("i"), "tag")))
    plans = joined.groupBy(*keys).agg(first(F.col("order")).alias("order_idx"), first(F.col("search")).alias("search_idx"), best.alias("best"))
    rows = rows.join(plans, list(keys))
    way = js.extract(goal, r"\b(down|up|top|bottom)\b", 1, True)
    key = F.lower(js.extract(goal, r"\b(enter|tab|escape|esc|backspace)\b", 1, True))
    steps = (
        (js.matches(goal, BACK, True), "navigate", F.lit("history:back"), None),
        (js.matches(goal, FORWARD, True), "navigate", F.lit("history:forward"), None),
        (F.col(navigation).isNotNull(), "navigate", F.col(navigation), None),
        (js.matches(goal, FILL, True), "autofill", None, None),
        (js.matches(goal, SCROLL, True), "scroll", F.coalesce(js.some(F.lower(way)), F.lit("down")), None),
        (js.matches(goal, PRESS, True), "press_key", F.when(key.startswith("esc"), "Escape").otherwise(F.initcap(key)), None),
        (F.col("order_idx").isNotNull(), "click", None, F.col("order_idx")),
        (F.col("search_idx").isNotNull(), "type", F.col(query), F.col("search_idx")),
        (F.col("best").isNotNull() & (F.col("best.tag") == "select"), "select", None, -F.col("best.i")),
        (F.col("best").isNotNull(), "click", None, -F.col("best.i")),
        (F.lit(True), "finish", None, None),
    )
    none = F.lit(None)
    chain = None
    for test, action, value, idx in steps:
        row = F.struct(F.lit(action).alias("action"), (none if value is None else value).cast("string").alias("value"), (none if idx is None else idx).cast("int").alias("idx"))
        chain = F.when(test, row) if chain is None else chain.when(test, row)
    return rows.select(*keys, chain.alias("p")).select(*keys, "p.*")
