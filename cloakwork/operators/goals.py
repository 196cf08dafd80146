"""Understanding of goals: queries, intents, splitting, navigation, macros and routes.

Each function takes a dialect and a SQL expression and gives an expression.
"""

from __future__ import annotations

from cloakwork.functions.dialect import Spark, chain, trim, words
from cloakwork.functions.platforms import PLATFORMS

# The patterns and word lists that results depend on.
VERBS = r"(?:search(?:\s+for)?|find|type|look(?:\s+for)?|query)"
QUERY_PY = VERBS + r"\s+['\"]?([^'\"]+?)['\"]?(?:\s+(?:in|on|into|at|using)\b.*)?$"
TAIL_PY = r"\s+(?:in|on|into|at|using)\s+.*$"
QUERY_TS = VERBS + r"\s+['\"]?([^'\"]+?)['\"]?(?:\s+(?:in|on|into|at|using|and\s+press\s+enter|and\s+enter)\b.*)?$"
TAIL_TS = r"\s+(?:in|on|into|at|using|and\s+press\s+enter|and\s+enter)\s+.*$"
SITE = r"\b(?:in|on)\s+([a-zA-Z0-9.-]+\.[a-zA-Z]{2,}|[a-zA-Z0-9_-]+)\b"
NOT_SITES = ("the", "this", "that", "screen", "page", "tab", "browser", "web", "internet", "google")
STRONG = r"\s+(?:and\s+then|then|after\s+that)\s+"
NEXT_VERB = r"add\s+to\s+cart|add\s+it\s+to\s+cart|buy\s+now|proceed|checkout|open|go\s+to|navigate|visit|auto\s*fill|fill|click|tap|press|scroll|search|type|look|find|submit|track|play|watch|listen|stream|go\s*back|back|previous|go\s*forward|forward|next\s+page|undo"
DIRECT = r"\b(?:click|tap|press|select|open|go\s+to|navigate|visit|browse|scroll|auto\s*fill|fill|search|type|find|look\s+for|buy|pay|checkout|order|play|watch|listen|stream|go\s*back|back|previous|go\s*forward|forward|next\s+page|undo)\b"
DOMAIN = r"^[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(\/[^\s]*)?$"
NOT_NAVIGATION = (
    r"^(?:open\s+)?product(?::|\s|$)",
    r"\bproduct:\s*",
    r"\b(?:cart|carts|my\s+cart|order|orders|menu|modal|popup|dropdown|accordion|tab|buy\s+now|add\s+to\s+cart|here|there)\b",
    r"\b(?:go\s*back|navigate\s*back|take\s*me\s*back|previous\s*page|previous\s*step|return\s*to\s*previous|undo|go\s*forward|forward|next\s*page)\b",
    r"^(?:play|watch|listen|stream)\b",
)
NAVIGATION = r"^(?:please\s+|can\s+you\s+|then\s+we\s+will\s+|we\s+will\s+|then\s+)?(?:open|go\s+to|navigate(?:\s+to)?|visit|browse(?:\s+to)?)\s+(?:the\s+(?:website|site|page|url)\s+)?['\"]?([^'\"]+?)['\"]?$"
NOT_TARGET = r"^(?:product|item|cart|order|video|song|track|link|button|tab)(?::|\s|$)"
NOT_BRAND = r"^(?:product|item|cart|order|video|song|track|link|button|tab|page|here|there|menu|modal|popup|dialog|overlay|back|forward|previous|next)$"
PAIR = r"(?:set|fill|with\s+)?([a-zA-Z\s_-]+?)\s*(?:=|:|\bas\b|\bto\b)\s*['\"]?([^,;]+?)['\"]?(?:,|$|\sand\s)"
AUTOFILL = r"\b(?:auto\s*fill|fill\s*(?:my\s*)?(?:details|form|data|credentials|address|kyc|info)|populate\s*form)\b"
BACK = r"\b(?:go\s*back|navigate\s*back|take\s*me\s*back|back|previous\s*page|go\s*to\s*previous\s*page|previous\s*step|return\s*to\s*previous|undo(?:\s*step)?)\b"
FORWARD = r"\b(?:go\s*forward|navigate\s*forward|forward|next\s*page|go\s*to\s*next\s*page)\b"
GENERIC_CLICK = (
    r"\b(?:click|tap|press|select)\s+(?:here|there|it|this|that|this\s+(?:button|link|item|element)|that\s+(?:button|link|item|element)|the\s+(?:button|link|item|element)|on\s+(?:the\s+)?screen|(?:button|link|element)\s+on\s+(?:the\s+)?screen|this\s+button\s+or\s+link(?:\s+on\s+(?:the\s+)?screen)?)\b",
    r"^\s*(?:please\s+)?(?:click|tap|press|select)\s+(?:on\s+)?(?:screen|this\s+screen|the\s+screen|this|that|it)\s*$",
    r"\b(?:this\s+button\s+or\s+link\s+on\s+(?:the\s+)?screen|button\s+or\s+link\s+on\s+(?:the\s+)?screen)\b",
)
CLICK_VERB = r"\b(?:click|tap|press|select|open|go\s+to)\s+(?:on\s+)?"
MACRO_WRAP = r"^(?:please\s+)?(?:play|run|trigger|execute|open|start|activate|my\s+favorite|favorite|favourite|go\s+to|switch\s+to)\s+"
MACRO_END = r"\s+(?:shortcut|macro|command|category|routine|please)$"
MACRO_VERBS = ("play", "open", "search", "find", "click", "go", "buy", "watch", "listen", "stream")
ALIASES = {
    "music": ("music", "spotify", "audio", "track", "gaana", "gana"),
    "e-com": ("e com", "ecom", "ecommerce", "shopping"),
    "cart & vault": ("cart and vault", "vault", "autofill", "checkout"),
    "scroll": ("scroll", "scrolling"),
    "search": ("search", "quick search"),
    "deep nav": ("deep nav", "navigator"),
}


def _query(d: Spark, x: str, pattern: str, tail: str) -> str:
    g = trim(d, x)
    found = trim(d, d.sub(trim(d, d.extract(g, pattern)), tail))
    return f"coalesce(nullif({found}, ''), {g})"


def query_py(d: Spark, x: str) -> str:
    return _query(d, x, QUERY_PY, TAIL_PY)


def query_ts(d: Spark, x: str) -> str:
    return _query(d, x, QUERY_TS, TAIL_TS)


def site(d: Spark, x: str) -> str:
    """The platform named after in or on; null if there is none."""
    s = f"lower({d.extract(trim(d, x), SITE)})"
    return f"case when {s} in {words(d, (*NOT_SITES, ''))} then null else {s} end"


def intent_query(d: Spark, x: str) -> str:
    g = trim(d, x)
    q = trim(d, chain(d, g, rf"^(?:please\s+)?{VERBS}\s+", r"\s+(?:in|on)\s+([a-zA-Z0-9.-]+\.[a-zA-Z]{2,}|[a-zA-Z0-9_-]+)\b.*$", r"\s+(?:and\s+press\s+enter|and\s+enter)\s*$", "^[\"']|[\"']$"))
    return f"coalesce(nullif({q}, ''), {g})"


def platform_url(d: Spark, name: str) -> str:
    cases = " ".join(f"when {d.lit(k)} then {d.lit(v)}" for k, v in PLATFORMS.items())
    return f"case {name} {cases} end"


def intent_url(d: Spark, s: str, url: str) -> str:
    """Where a search has to go first; null on the site already."""
    return f"case when {s} is null or contains(lower({url}), {s}) then null else coalesce({platform_url(d, s)}, case when contains({s}, '.') then concat('https://', {s}) else concat('https://', {s}, '.com') end) end"


def split(d: Spark, x: str) -> str:
    """The parts of a compound command."""
    n = trim(d, x)
    mark = "\x01"
    strong = d.split(n, STRONG)
    weak = d.split(d.sub(n, rf"\s+and\s+((?:{NEXT_VERB})\b)", mark + "@1"), mark)
    clean = lambda xs: d.filter(d.transform(xs, "p", trim(d, "p")), "p", "p <> ''")
    return f"case when {d.size(strong)} > 1 then {clean(strong)} else {clean(weak)} end"


def is_direct(d: Spark, x: str) -> str:
    return f"({d.match(x, DIRECT)} or {d.match(trim(d, x), DOMAIN)} or {d.match(trim(d, x), '^https?://')})"


def navigation(d: Spark, x: str) -> str:
    """The address or name that a goal wants opened; null if it is no navigation."""
    s = trim(d, x)
    url = d.extract(s, r"https?://[^\s'\"]+", 0)
    raw = trim(d, d.extract(s, NAVIGATION))
    low = d.sub(f"lower({raw})", r"^www\.")
    barred = " or ".join(d.match(s, p) for p in NOT_NAVIGATION)
    return f"""case when {url} <> '' then {url} when {d.match(s, DOMAIN)} then {s} when {barred} then null
      when {raw} = '' or {d.match(raw, NOT_TARGET)} then null when {low} in {words(d, PLATFORMS)} then {raw}
      when {d.match(raw, r'^[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(/.*)?$')} then {raw} when {d.match(s, r'\b(?:website|site|\.com|\.in|\.org|\.net)\b')} then {raw}
      when {d.match(raw, '^[a-zA-Z0-9_-]{3,24}$')} and not {d.match(raw, NOT_BRAND)} then {raw} else null end"""


def pairs(d: Spark, x: str, by_key: bool = True) -> str:
    """Keys and values given in a prompt as 'key=value' strings, by key or as they stand; of equal keys the last holds."""
    keys, vals = d.extract_all(x, PAIR, 1), d.extract_all(x, PAIR, 2)
    key = lambda k: d.sub(f"lower({trim(d, k)})", r"^(?:and|with|set|fill|the)\s+")
    ks, vs = d.transform(keys, "k", key("k")), d.transform(vals, "v", trim(d, "v"))
    zipped = f"arrays_zip({ks}, {vs})" if type(d) is Spark else f"list_zip({ks}, {vs})"
    k, v = ("p['0']", "p['1']") if type(d) is Spark else ("p[1]", "p[2]")
    kept = d.filter(zipped, "p", f"{k} <> '' and {v} <> '' and {k} not in ('a', 'an', 'the', 'my', 'auto', 'in') and length({k}) < 30")
    if type(d) is Spark:
        last = "filter(ps, (p, i) -> not exists(slice(ps, i + 2, size(ps)), q -> q['0'] = p['0']))"
        found = d.let("ps", kept, d.transform(last, "p", f"concat({k}, chr(61), {v})"))
        return f"array_sort({found})" if by_key else found
    last = f"list_filter({kept}, lambda p, i: len(list_filter(({kept})[i + 1:], lambda q: q[1] = p[1])) = 0)"
    found = d.transform(last, "p", f"concat({k}, chr(61), {v})")
    return f"list_sort({found})" if by_key else found


def pair_map(x):
    """The pairs of a prompt column as a map."""
    from pyspark.sql import functions as F

    entries = F.transform(F.expr(pairs(Spark(), x)), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2).alias("value")))
    return F.map_from_entries(entries)


def click_target(d: Spark, x: str) -> str:
    """The label to click; null for here and there."""
    generic = " or ".join(d.match(x, p) for p in GENERIC_CLICK)
    start = d.sub_first(d.sub(x, r"^\s*(?:please\s+)?"), CLICK_VERB)
    screen = (GENERIC_CLICK[2], r"\b(?:on\s+(?:the\s+)?screen|on\s+screen)\b")
    named = r"\b(?:this|that|the)\s+(?:button|link|element|item)\b"
    article = r"^(?:the|a|an|this|that)\s+"
    modifier = trim(d, d.sub(trim(d, chain(d, start, *screen, named, r"\b(?:button|btn|link|tab|card|element|item)\b", r"\b(?:here|there|it|this|that)\b", "^[\"']|[\"']$")), article))
    plain = trim(d, d.sub(trim(d, chain(d, start, *screen, r"\b(?:this\s+button\s+or\s+link|button\s+or\s+link)\b", named, r"\b(?:button|btn|link|tab|card|pe\s+click\s+kro|pe\s+click\s+karo|kro|karo|pe|waale|wale)\b", "^[\"']|[\"']$")), article))
    return f"case when {generic} then case when length({modifier}) < 2 then null else {modifier} end when {d.match(x, r'\b(?:play|watch|listen(?:\s+to)?|stream)\b')} then {trim(d, x)} else nullif({plain}, '') end"


def milestone(d: Spark, s: str, nav: str, q: str, target: str) -> tuple[str, str]:
    """(category, label) of a trimmed sub-goal, given its navigation target, query and label
    to click."""
    short = lambda v, n, most: f"case when length({v}) > {most} then concat(substr({v}, 1, {n}), '...') else {v} end"
    tests = (
        (d.match(s, AUTOFILL), "autofill", "'Zero-Leak Vault Autofill'"),
        (d.match(s, BACK), "navigate", "'Go Back to Previous Page / Step'"),
        (d.match(s, FORWARD), "navigate", "'Go Forward to Next Page'"),
        (f"({nav} is not null or {d.match(s, r'\b(?:open|go\s+to|navigate|visit|launch)\b')})", "navigate", f"concat('Navigate to ', coalesce({nav}, {d.sub_first(s, r'\b(?:open|go\s+to|navigate|visit)\s+')}))"),
        (d.match(s, r"\b(?:search|find|query|type|look\s+for)\b"), "search", f"concat('Search: \"', {short(q, 28, 28)}, '\"')"),
        (d.match(s, r"\b(?:add\s*(?:it\s*)?to\s*cart|add\s*cart|buy|order|checkout|pay)\b"), "interact", "'E-Commerce Action & Verification'"),
        (d.match(s, r"\b(?:click|tap|press|select)\b"), "interact", f"concat('Click \"', coalesce({target}, 'Element'), '\"')"),
        (d.match(s, r"\b(?:scroll|page)\b"), "system", "'Scroll Viewport'"),
    )
    category = "case " + " ".join(f"when {t} then '{c}'" for t, c, _ in tests) + " else 'verify' end"
    label = "case " + " ".join(f"when {t} then {v}" for t, _, v in tests) + f" else {short(s, 35, 38)} end"
    return category, label


def normalize_url(d: Spark, x: str) -> str:
    t = trim(d, x)
    return f"""case when {d.match(t, '^https?://')} then {t} else coalesce({platform_url(d, f'lower({t})')},
      case when {d.match(t, r'^[a-zA-Z0-9-]+(\.[a-zA-Z0-9-]+)+(:\d+)?(/.*)?$')} then concat('https://', {t})
      when {d.match(t, '^[a-zA-Z0-9_-]+$')} and length({t}) >= 3 then concat('https://www.', lower({t}), '.com')
      else concat('https://www.google.com/search?q=', {d.encode(t)}) end) end"""


def normal_key(d: Spark, x: str) -> str:
    return trim(d, chain(d, f"lower({x})", (r"[-_&/\\+]", " "), r"[.,#!$%\^*;:{}=`~()?\"']", (r"\s+", " ")))


def macro_terms(d: Spark, x: str) -> tuple[str, str]:
    """(stripped, clean): the terms that may name a macro; null where none can."""
    clean = normal_key(d, x)
    stripped = trim(d, chain(d, clean, MACRO_WRAP, MACRO_END))
    fits = f"({d.size(d.split(stripped, r'\s+'))} <= 3 or {d.match(clean, r'\b(?:shortcut|macro|category|routine)\b')})"
    ok = f"{clean} <> '' and {clean} not in {words(d, MACRO_VERBS)} and {stripped} not in ('', 'play', 'open', 'click') and {fits}"
    return f"case when {ok} then {stripped} end", f"case when {ok} then {clean} end"


def alias_test(d: Spark, tag: str, term: str) -> str:
    """Does the term name a macro of the normalized tag."""
    tests = [f"{tag} = {term}"]
    for name, others in ALIASES.items():
        canon = " ".join(name.replace("-", " ").replace("&", " ").split())
        tests.append(f"({term} in {words(d, others)} and (contains({tag}, {d.lit(canon)}) or contains({d.lit(canon)}, {tag})))")
    return f"({tag} <> '' and ({' or '.join(tests)}))"


def wake_command(d: Spark, x: str) -> str:
    """The command after a wake word; empty if there is none."""
    return trim(d, d.extract(x, r"\b(?:hey|hi|ok|okay|hello)\s+nova\b[\s,.:!-]*(.*)$"))
