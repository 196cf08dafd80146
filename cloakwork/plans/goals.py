"""Queries over goals and addresses: inline ones, and some made of every part's name."""

from __future__ import annotations

from cloakwork.functions.dialect import Duck, Spark, query, trim, values
from cloakwork.operators import agent
from cloakwork.operators import goals as g
from cloakwork.operators import missions

GOALS = (
    (1, "Search tum hi ho on spotify", "https://www.google.com"), (2, "Open carts and auto filling my details", ""), (3, "Open amazon and go to my carts", ""),
    (4, "Search for laptop and press enter", ""), (5, "Find Cancellation Policy", ""), (6, "Scroll down and click here", ""), (7, "Scroll up", ""),
    (8, "search for Gaming Laptop", ""), (9, "find iphone 16 on amazon", "https://www.amazon.in/s"), (10, "type hello world into input", ""),
    (11, "open https://news.site.com/x?a=1 now", ""), (12, "please open 'starbucks'", ""), (13, "amazon.in", ""), (14, "go back", ""), (15, "visit the website two words", ""),
    (16, "click the pink button on the screen", ""), (17, "tap here", ""), (18, 'play "tum hi ho"', ""), (19, "set city to Pune, name = Rahul and phone: 98765", ""),
    (31, "set city to Pune, name = Rahul, city to Delhi", ""), (32, "find the refund policy of this shop", ""), (20, "open flipkart and search iphone and add it to cart then checkout", ""), (21, "play music shortcut", ""), (22, "run e-com", ""), (23, "trigger vault please", ""),
    (24, "click Proceed button", ""), (25, "", ""), (26, "hey nova, open irctc", ""), (27, "fill my details as soon as possible", ""), (28, "next page", ""), (29, "buy now", ""), (30, "summarise what is visible on this tab for me please", ""),
)
MACROS = ((1, "Music", "Search tum hi ho on spotify", True), (2, "Cart & Vault", "Open carts and auto filling my details", True), (3, "E-Com", "Open amazon and go to my carts", True), (4, "Search", "Search for laptop and press enter", True), (5, "Deep Nav", "Find Cancellation Policy", True), (6, "Scroll", "Scroll up", False), (7, "Scroll", "Scroll down and click here", True))


def goals(d: Spark) -> str:
    made = "case p_partkey % 6 when 0 then concat('search for ', p_name, ' on amazon') when 1 then concat('open ', replace(p_name, ' ', ''), ' and click ', p_brand) when 2 then concat('find ', p_name, ' and press enter') when 3 then concat('set name to ', p_name, ', brand: ', p_brand) when 4 then concat('play ', p_name, ' then scroll down') else concat('click the ', p_name, ' button') end"
    return f"(select goal_id, text, url from {values(d, 'goal_id, text, url', GOALS)} x union all select 1000 + p_partkey, {made}, 'https://www.google.com/' from {d.table('part')})"


def plain(**columns):
    """A query of expressions over every goal."""

    def make(d: Spark) -> str:
        return f"select goal_id, {', '.join(f'{f(d)} as {n}' for n, f in columns.items())} from {goals(d)} t"

    return make


def urls(d: Spark) -> str:
    extra = values(d, "id, raw", ((-1, "https://a.b"), (-2, "irctc"), (-3, "news.site.com/x"), (-4, "starbucks"), (-5, "two words"), (-6, " Amazon "), (-7, "ab"), (-8, "a+b & c/d")))
    return f"select id, raw, {g.normalize_url(d, 'raw')} as url from (select * from {extra} x union all select page_id, {d.sub('url', '^https?://')} from {d.table('pages')} union all select 100000 + p_partkey, p_name from {d.table('part')}) t"


def splits(d: Spark) -> str:
    return f"select goal_id, cast(i as int) as pos, part from (select goal_id, {g.split(d, 'text')} as parts from {goals(d)} x) t {d.each('parts', 'part')}"


def milestones(d: Spark) -> str:
    parts = f"select goal_id, text, i, part from (select goal_id, text, {g.split(d, 'text')} as parts from {goals(d)} x) t {d.each('parts', 'part')}"
    facts = f"select goal_id, text, i, part, {g.navigation(d, 'part')} as nav, {g.query_ts(d, 'part')} as q, {g.click_target(d, 'part')} as target from ({parts}) p"
    category, label = g.milestone(d, "part", "nav", "q", "target")
    return f"select goal_id, cast(i as int) as pos, {category} as category, {label} as label, {missions.route(d, 'part', 'nav', 'text')} as route from ({facts}) f"


def macros(d: Spark) -> str:
    """Each goal's macro: by the stripped term before the whole, a favourite before others."""
    stripped, clean = g.macro_terms(d, "text")
    table = values(d, "id, tag, act, favourite", MACROS)
    terms = f"(select goal_id, {stripped} as a, {clean} as b from {goals(d)} x)"
    each = f"(select goal_id, 1 as k, a as term from {terms} y where a is not null union all select goal_id, 2, b from {terms} z where b is not null)"
    ranked = f"select goal_id, m.id, act, row_number() over (partition by goal_id order by k, favourite desc, m.id) as r from {each} e join (select *, {g.normal_key(d, 'tag')} as norm from {table} q) m on {g.alias_test(d, 'm.norm', 'e.term')}"
    return f"select goal_id, id as macro_id, act from ({ranked}) t where r = 1"


def routes(d: Spark) -> str:
    """Where a goal goes first, once a macro that it names has taken its place: the compound pipeline, a deep search for a
    policy page, or the step loop."""
    named = f"(select x.goal_id, coalesce(m.act, x.text) as text, '' as url, m.macro_id from {goals(d)} x left join ({macros(d)}) m on m.goal_id = x.goal_id)"
    rows = f"select goal_id, macro_id, {missions.steps(d)} is not null or {d.size(g.split(d, 'text'))} > 1 or {g.is_direct(d, 'text')} as compound, {d.match('text', agent.POLICY)} as policy, {trim(d, d.extract('text', agent.POLICY_NAME))} as term from {named} x"
    return f"select goal_id, macro_id, case when compound then 'compound' when policy and term <> '' then 'deep_search' else 'loop' end as route, case when not compound and policy and term <> '' then term end as term from ({rows}) r"


def decompositions(d: Spark) -> str:
    """The sub-goals of goals on platforms."""
    return f"select goal_id, cast(i as int) as pos, step from (select goal_id, {missions.steps(d)} as steps from {goals(d)} s) t {d.each('steps', 'step')}"


def intent(d: Spark) -> str:
    return f"select goal_id, {g.intent_query(d, 'text')} as query, site, {g.intent_url(d, 'site', 'url')} is not null as needs_navigation, {g.intent_url(d, 'site', 'url')} as nav_url from (select *, {g.site(d, 'text')} as site from {goals(d)} x) t"


MAKERS = {
    "extract_query_py": (plain(query=lambda d: g.query_py(d, "text")), "part"),
    "extract_query_ts": (plain(query=lambda d: g.query_ts(d, "text")), "part"),
    "search_intent": (intent, "part"),
    "page_route": (routes, "part"),
    "split_compound": (splits, "part"),
    "decompose_goal": (decompositions, "part"),
    "goal_routes": (lambda d: missions.routed(d, goals(d)), "part"),
    "direct_command": (plain(direct=lambda d: g.is_direct(d, "text")), "part"),
    "nav_target": (plain(target=lambda d: g.navigation(d, "text")), "part"),
    "kv_map": (plain(pairs=lambda d: d.join(g.pairs(d, "text"), ";")), "part"),
    "click_target": (plain(target=lambda d: g.click_target(d, "text")), "part"),
    "milestones": (milestones, "part"),
    "macro_lookup": (macros, "part"),
    "normalize_urls": (urls, "pages", "part"),
    "wake_command": (plain(command=lambda d: g.wake_command(d, "text")), "part"),
}
QUERIES = {k: query(make, *tables) for k, (make, *tables) in MAKERS.items()}
SQL = {k: make(Duck()) for k, (make, *_) in MAKERS.items()}
