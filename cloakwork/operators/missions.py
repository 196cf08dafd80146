"""From one goal to an ordered list of sub-goals, and each sub-goal's route with its parameter.

A goal that names a platform becomes addresses and steps on it; another is split at its conjunctions. Everything is
an expression over the goal's row, in which each intermediate value has a name and is computed once.
"""

from __future__ import annotations

from cloakwork.functions.dialect import Spark, chain, trim, words
from cloakwork.functions.platforms import CARTS, ORDER, PLATFORMS, PLAYERS, SEARCHES
from cloakwork.operators import goals as g

# The patterns that results depend on.
NAMES = "|".join(ORDER)
PLACE = r"[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
NO_PLATFORMS = ("the", "this", "that", "screen", "page", "tab", "browser", "web", "internet", "google", "product", "cart")
ON_PAGE = r"^(?:please\s+)?(?:click|tap|press|select|choose|scroll|page|auto\s*fill|fill)\b"
OPENS = rf"\b(?:open|go\s+to|visit|launch|browse(?:\s+to)?)\s+({PLACE}|{NAMES}|[a-zA-Z0-9_-]+)\b"
STANDS = rf"\b(?:in|on|at|onto|from|using)\s+({PLACE}|{NAMES}|[a-zA-Z0-9_-]+)\b"
SEARCHED = rf"\bsearch\s+({NAMES})\s+(?:for\s+)?"
SEARCHES_FIRST = rf"^({NAMES})\s+(?:search|find|play)\b"
WANTS = r"\b(?:search(?:\s+for)?|find|look\s*for|query|play|watch|listen(?:\s+to)?|stream)\b"
PLAYS = r"\b(?:play|watch|listen(?:\s+to)?|stream)\b"
BUYS = r"\b(?:add\s*(?:it\s*)?to\s*cart|add\s*cart|buy(?:\s+now|\s+it)?|order(?:\s+now|\s+it)?)\b"
VIEWS_CART = r"\b(?:open|view|show|check|go\s+to)?\s*(?:my\s+)?carts?\b"
ADDS = r"\b(?:add\s*(?:it\s*)?to\s*cart|add\s*cart)\b"
PICKS = r"\b(?:open\s+(?:product|it|the|item|result)|select|view|choose|click\s+(?:on\s+)?(?:product|item|result|first))\b"
SOUNDS = "spotify|youtube|gaana|jiosaavn|wynk|soundcloud|music|audio"
OPENED = rf"^(?:open|go\s+to|visit|launch)\s+(?:{NAMES}|{PLACE})\s*(?:and\s+)?"
CLEAN = (
    rf"\b(?:in|on|at|onto|from|using)\s+(?:{NAMES}|{PLACE})\b.*$",
    rf"^search\s+(?:{NAMES})\s+(?:for\s+)?",
    r"^(?:please\s+)?(?:search(?:\s+for)?|find|look\s*for|query|type|open|go\s+to|visit)\s+",
    r"^(?:please\s+)?(?:play|watch|listen(?:\s+to)?|stream)\s+",
    r"^(?:please\s+)?(?:buy|order|add\s*(?:it\s*)?to\s*cart)\s+",
    r"^(?:the\s+)?(?:song|track|video|music)\s+",
    r"\s+(?:and\s+)?(?:play\s+it|play|watch\s+it|watch|listen\s+to\s+it|listen|stream\s+it|stream)\s*$",
    r"\s+(?:and\s+)?(?:add\s*(?:it\s*)?to\s*cart|add\s*cart|buy(?:\s+now|\s+it)?|order(?:\s+now|\s+it)?)\s*$",
    r"\s+and\s+(?:play|watch|listen|stream|add|buy|order).*$",
    r"\s+and\s*$",
    "^[\"']|[\"']$",
)
VIEWS = r"^(?:cart|carts|my\s+cart|order|orders|account|profile|menu|home)$"
MEDIA = r"^(?:please\s+)?(?:play|watch|listen(?:\s+to)?|stream)\s+['\"]?(.+?)['\"]?$"
SCROLLS = r"\b(?:scroll|page)\s*(?:down|up|to\s+top|to\s+bottom|top|bottom)?\b"
TO_CART = r"\b(?:open|go\s+to|view|show|check)\s+(?:my\s+)?carts?\b"
FINDS = r"\b(?:search|find|look\s*for)\b"
ADDS_NAMED = r"\b(?:add\s*(?:the\s*)?.+?\s*to\s*cart|buy\s+.+)\b"
TYPES = r"\b(?:search(?:\s+for)?|type|look\s+for|query)\b"
CLICKS = r"\b(?:click|tap|press|select|open|go\s+to|buy|pay|checkout|order|add\s*(?:it\s*)?to\s*cart|add\s*cart|play|watch|listen|stream)\b"
POLICY = r"\b(?:policy|privacy|terms|cancellation|refund|contact|support|kyc)\b"
PRODUCT = r"open product:\s*(.+?)(?:\s+and\s+add\s+to\s+cart|$)"
PRODUCT_RAW = (r"^(?:please\s+)?(?:open|go\s+to|visit)\s+[a-z0-9.-]+\s*(?:and\s+)?", r"^(?:search(?:\s+for)?|find|look\s*for|buy(?:\s+now)?|order|get)\s+", r"\s+(?:in|on|at)\s+[a-z0-9.-]+$", r"\s+and\s+(?:add\s+to\s+cart|buy(?:\s+now)?|order).*$", r"\badd\s+(?:it\s*)?to\s*cart\b", r"\bto\s*cart\b", r"\bbuy\s+now\b")
PRODUCT_PART = (r"^(?:add|buy|order)\s+", r"\s+to\s+cart.*$", r"\bbuy\s+now\b")
TRAILING = r"\s+(?:and\s+)?(?:play\s+it|play|watch\s+it|watch|listen\s+to\s+it|listen|stream\s+it|stream)\s*$"
MEDIA_PART = (r"^(?:please\s+)?(?:play|watch|listen(?:\s+to)?|stream|open)\s+", r"^(?:the\s+)?(?:song|track|video|music)\s+", r"\s+(?:in|on|at)\s+[a-z0-9.-]+$", TRAILING, "^[\"']|[\"']$")
MEDIA_RAW = (r"^(?:please\s+)?(?:play|watch|listen(?:\s+to)?|stream|search(?:\s+for)?|find|look\s*for)\s+", r"^(?:the\s+)?(?:song|track|video|music)\s+", r"\s+(?:in|on|at|onto|from|using)\s+[a-z0-9.-]+.*$", TRAILING, "^[\"']|[\"']$")
PRONOUN = r"^(?:it|this|that|one|song|video|music|track|the\s+song|the\s+video)$"


def uri(d: Spark, x: str) -> str:
    """A text as a component of an address; marks that ECMAScript leaves stay."""
    out = d.encode(x)
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~")):
        out = f"replace({out}, {d.lit(code)}, {d.lit(mark)})"
    return out


def _first(d: Spark, names, test) -> str:
    """The first of the names that passes; null if none does."""
    return d.at(d.filter(d.array(*map(d.lit, names)), "k", test), 0)


def _case(d: Spark, key: str, table: dict[str, str]) -> str:
    return f"case {key} " + " ".join(f"when {d.lit(k)} then {d.lit(v)}" for k, v in table.items()) + " end"


def steps(d: Spark, text: str = "text", url: str = "url") -> str:
    """The sub-goals of a goal on a platform, as an array; null where it is none."""
    usable = lambda x: d.let("w", f"lower({x})", f"case when w in {words(d, NO_PLATFORMS)} or w = '' then null else w end")
    barred = f"g = '' or ({d.match('g', ON_PAGE)} and not {d.match('g', rf'\b(?:open|go\s+to|visit|launch)\s+(?:{NAMES})\b')})"
    named = _first(d, [k for k in ORDER if len(k) > 2], d.word_in("k", "g"))
    raw = f"coalesce({usable(d.extract('g', OPENS))}, {usable(d.extract('g', STANDS))}, nullif(lower({d.extract('g', SEARCHED)}), ''), nullif(lower({d.extract('g', SEARCHES_FIRST)}), ''), {named})"
    platform = f"case when raw is not null then coalesce({_first(d, ORDER, 'contains(raw, k)')}, raw) when {d.match('g', WANTS)} then {_first(d, ORDER, f'contains(lower({url}), k)')} end"
    start = f"case when {d.match('g', OPENED)} then {d.sub('g', OPENED)} else regexp_replace(g, {d.lit('(?i)^(?:open|go[\\s]+to|visit|launch)[\\s]+(?:')} || coalesce(platform, '-') || {d.lit(')[\\s]*(?:and[\\s]+)?')}, '') end"
    query = d.let("asked", trim(d, chain(d, start, *CLEAN)), f"case when {d.match('asked', VIEWS)} then '' else asked end")
    song = trim(d, chain(d, trim(d, d.extract("g", MEDIA)), r"^(?:the\s+)?(?:song|track|video|music)\s+", r"^for\s+"))
    site, finder, cart = f"coalesce({_case(d, 'platform', PLATFORMS)}, '')", _case(d, "platform", SEARCHES), _case(d, "platform", CARTS)
    quoted = "concat('\"', q, '\"')"
    home = f"case when {site} <> '' then {site} else concat('https://www.', platform, '.com') end"
    view = f"case when {cart} is not null then {d.array(f'concat({d.lit("open ")}, {cart})')} else {d.array(f'concat({d.lit("open ")}, {home})', d.lit('open cart'))} end"
    go = f"case when {finder} is not null then concat('open ', {finder}, {uri(d, 'q')}) when contains(lower({url}), platform) then null when {site} <> '' then concat('open ', {site}) else concat('open https://', raw) end"
    look = f"case when {finder} is null then concat('search for ', {quoted}, ' in ', platform, ' and press enter') end"
    media = f"(platform in {words(d, PLAYERS)} or {d.match('g', PLAYS)} or {d.match('platform', SOUNDS)})"
    then = f"case when {d.match('g', PLAYS)} and {media} then concat('play ', {quoted}) when {d.match('g', BUYS)} then concat('open product: ', q, ' and add to cart') when {d.match('g', PICKS)} then concat('open product: ', q) end"
    found = d.filter(d.array(go, look, then), "s", "s is not null")
    default = d.let("song", song, f"case when {d.match('g', MEDIA)} and length(song) >= 2 then {d.array(f'concat({d.lit("open " + SEARCHES["youtube"])}, {uri(d, "song")})', f'concat({d.lit("play " + chr(34))}, song, {d.lit(chr(34))})')} end")
    chosen = f"case when platform is not null and {d.match('g', VIEWS_CART)} and not {d.match('g', ADDS)} then {view} when platform is not null and q <> '' and lower(q) <> platform and length(q) >= 2 then {found} else {default} end"
    return d.let("g", trim(d, text), f"case when {barred} then null else {d.let('raw', raw, d.let('platform', platform, d.let('q', query, chosen)))} end")


def sub_goals(d: Spark, rows: str) -> str:
    """(goal_id, text, url, i, part): a goal's sub-goals, of its platform or by its conjunctions."""
    found = f"select goal_id, text, url, coalesce({steps(d)}, {g.split(d, 'text')}) as parts from {rows} p0"
    return f"select goal_id, text, url, i, part from ({found}) p1 {d.each('parts', 'part')}"


def route(d: Spark, s: str, nav: str, whole: str) -> str:
    """The branch that handles a trimmed sub-goal of a whole goal, in fixed precedence."""
    tests = (
        ("scroll", d.match(s, SCROLLS)),
        ("autofill", d.match(s, g.AUTOFILL)),
        ("history", f"({d.match(s, g.BACK)} or {d.match(s, g.FORWARD)})"),
        ("navigate", f"{nav} is not null"),
        ("cart", d.match(s, TO_CART)),
        ("product", f"(({whole} <> {s} and {d.match(whole, FINDS)} and {d.match(s, ADDS)}) or {d.match(s, ADDS_NAMED)})"),
        ("media", d.match(s, PLAYS)),
        ("search", d.match(s, TYPES)),
        ("click", d.match(s, CLICKS)),
        ("deep_search", d.match(s, POLICY)),
    )
    return "case " + " ".join(f"when {t} then '{n}'" for n, t in tests) + " else 'reason' end"


def product_query(d: Spark, s: str, whole: str) -> str:
    named = d.let("named", trim(d, d.extract(s, PRODUCT)), f"case when named <> '' then named else {trim(d, chain(d, whole, *PRODUCT_RAW))} end")
    return d.let("first", named, f"case when length(first) >= 2 then first else {trim(d, chain(d, s, *PRODUCT_PART))} end")


def media_query(d: Spark, s: str, whole: str) -> str:
    return d.let("own", trim(d, chain(d, s, *MEDIA_PART)), f"case when {d.match('own', PRONOUN)} or length(own) < 2 then {trim(d, chain(d, whole, *MEDIA_RAW))} else own end")


def parameter(d: Spark, kind: str, s: str, nav: str, whole: str, url: str) -> str:
    """What a route acts on: a direction, an address, a cart's address, a query, or a label; null where it takes none."""
    way = f"coalesce(nullif(lower({d.extract(s, r'\b(down|up|top|bottom)\b')}), ''), 'down')"
    cart = f"{_case(d, _first(d, CARTS, f'contains(lower({url}), k)'), CARTS)}"
    label = f"case when {d.match(s, r'\bbuy\s*now\b')} then 'buy now' when {d.match(s, ADDS)} then 'add to cart' else {g.click_target(d, s)} end"
    cases = {
        "scroll": way,
        "history": f"case when {d.match(s, g.BACK)} then 'back' else 'forward' end",
        "navigate": nav,
        "cart": f"case when contains(lower({url}), 'cart') then 'cart' else coalesce({cart}, 'cart') end",
        "product": product_query(d, s, whole),
        "media": media_query(d, s, whole),
        "search": g.intent_query(d, s),
        "click": label,
        "deep_search": s,
    }
    return f"case {kind} " + " ".join(f"when '{k}' then {v}" for k, v in cases.items()) + " end"


def routed(d: Spark, rows: str) -> str:
    """(goal_id, pos, sub_goal, route, parameter) of every sub-goal."""
    one = d.let("nav", g.navigation(d, "part"), d.let("kind", route(d, "part", "nav", "text"), f"{d.array('kind', parameter(d, 'kind', 'part', 'nav', 'text', 'url'))}"))
    return f"select goal_id, pos, sub_goal, {d.at('two', 0)} as route, {d.at('two', 1)} as parameter from (select goal_id, cast(i as int) as pos, part as sub_goal, {one} as two from ({sub_goals(d, rows)}) q0) q1"
