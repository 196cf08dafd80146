"""Queries over pages, products, media, form fields, plans, boxes and the step log."""

from __future__ import annotations

from cloakwork.functions.dialect import Duck, Spark, chain, query, trim, values
from cloakwork.operators import act, rank
from cloakwork.operators import goals as g
from cloakwork.plans.goals import GOALS
from cloakwork.sources import pages as p

SEARCHES = ((1, "cancellation policy"), (2, "contact"), (3, "next page about"), (4, "the"), (5, "home"))
FIELDS = (
    (1, "input", "text", "full_name", "", "Enter recipient name", "", "", "Asha Rao"), (2, "input", "email", "email", "", "name@domain.com", "", "", "a.rao@example.org"), (3, "input", "tel", "phone", "", "+91 XXXXX XXXXX", "", "", "9876501234"),
    (4, "input", "text", "aadhaar", "", "12-digit Aadhaar number", "", "", "432187652109"), (5, "input", "text", "address", "", "Flat, Street, Area", "", "", "12 Hill Road"), (6, "input", "text", "city", "", "City", "", "", "Pune"), (7, "input", "text", "pincode", "", "Postal PIN", "", "", "411001"),
    (8, "input", "text", "contact_email", "", "Email address", "", "", "b@example.org"), (9, "input", "search", "q", "", "Search city", "Search", "searchbox", "Pune"), (10, "input", "password", "pw", "input-password", "", "", "", ""), (11, "input", "text", "", "input-otp", "6-digit OTP code", "", "", "749210"),
    (12, "input", "text", "card_no", "", "", "Card number", "", ""), (13, "input", "text", "cvv", "", "CVV", "", "", "392"), (14, "input", "text", "x", "", "MM/YY", "", "", "08/29"), (15, "input", "text", "pan_number", "", "PAN", "", "", "ABCDE1234F"), (16, "button", "submit", "companion", "", "", "Expand panel", "", "Go"),
    (17, "input", "text", "upi_id", "", "VPA", "", "", "asha@okaxis"), (18, "input", "text", "ifsc", "", "", "IFSC code", "", "HDFC0001234"), (19, "textarea", "", "notes", "", "Your message", "", "", "hello there"), (20, "input", "text", "f1", "", "", "", "", "call 9876501234"), (21, "input", "radio", "gender", "", "", "", "", "f"), (22, "input", "date", "dob", "", "", "", "", "1990-01-01"), (23, "input", "text", "passport_no", "", "", "", "", "J1234567"),
)
COLUMNS = "el_id, tag, type, name, id, placeholder, aria, role, value"
ELEMENTS = (
    (0, "button", "My Orders", "", "", "btn-nav-orders", "", "#btn-nav-orders", False), (1, "button", "Profile", "Account", "", "btn-nav-profile", "", "#btn-nav-profile", False), (2, "button", "Cart", "", "", "btn-nav-cart", "", "#btn-nav-cart", False), (3, "a", "Track order", "", "", "btn-track-order-9821", "", "#btn-track-order-9821", False),
    (4, "button", "Proceed to checkout", "", "", "btn-proceed-checkout", "", "#btn-proceed-checkout", False), (5, "input", "", "Search products", "Search", "search", "q", "input[name=q]", False), (6, "input", "", "Password", "", "pw", "pw", "#pw", True), (7, "a", "Home", "", "", "", "", "a:nth-of-type(1)", False), (8, "a", "Home", "", "", "", "", "a:nth-of-type(1)", False), (9, "button", "Log in", "login", "", "", "", ".btn-login", False),
)
EL_COLUMNS = "idx, tag, text, aria, placeholder, id, name, selector, is_sensitive"
ACTIONS = ((1, "click", 4, "", "next step"), (2, "click", -1, "track", "look"), (3, "type", 6, "", "enter"), (4, "scroll", -1, "", "pay later"), (5, "click", -1, "Buy now", ""), (6, "click", -1, "nothing like it", "subscribe to news"), (7, "navigate", -1, "", "go home"), (8, "finish", 4, "", ""))
VAULT = (("email", "vault@example.org"), ("phone", "9000000001"), ("address", "1 Vault Lane"), ("city", "Pune"), ("pincode", "411001"), ("full_name", "Asha Rao"), ("dob", "1990-01-01"), ("aadhaar", "999911112222"), ("pan", "AAAAA0000A"), ("notes", "none"))


def page_links(d: Spark) -> str:
    return p.links(d, d.table("pages"))


def page_text(d: Spark) -> str:
    return f"select page_id, {p.title(d, 'html')} as title, {p.body(d, 'html')} as text from {d.table('pages')}"


def deep_search(d: Spark) -> str:
    scored = f"select page_id, query_id, i, text, href, section, {rank.deep_score(d, 'combined', 'q', 'section')} as score from (select l.*, query_id, q, concat(lower(text), '   ', lower(href)) as combined from ({p.links(d, d.table('pages'))}) l cross join {values(d, 'query_id, q', SEARCHES)} s) c"
    return f"select page_id, query_id, i, text, section, score from (select *, row_number() over (partition by page_id, query_id order by score desc, i) as r from ({scored}) z) w where r = 1 and score >= 3"


def element_cap(d: Spark) -> str:
    """The first 60 links of a page as elements, with labels and sensitivity."""
    rows = f"select page_id, row_number() over (partition by page_id order by i) - 1 as idx, substr(text, 1, {p.LABEL_MOST}) as label, {p.sensitive(d, ('href',), d.lit(''), 'text')} as is_sensitive from ({p.links(d, d.table('pages'))}) l"
    return f"select page_id, cast(idx as int) as idx, label, is_sensitive from ({rows}) t where idx < {p.ELEMENTS}"


def products(d: Spark) -> str:
    """Parts as cards for a query made of every part's name: the best card of each. Distinct queries meet
    distinct cards that share enough of their words, found by a join on words."""
    made = "lower(concat(p_name, ' ', p_type, case p_partkey % 5 when 0 then ' pro' when 1 then ' max 16' when 2 then ' case' when 3 then ' renewed m2' else ' m4' end))"
    cards = f"select min(p_partkey) as card, {made} as t, p_partkey % 7 = 0 as sponsored, p_partkey % 3 = 0 as cart from {d.table('part')} group by {made}, p_partkey % 7 = 0, p_partkey % 3 = 0"
    raws = f"select p_partkey, concat('buy ', p_name, case p_partkey % 3 when 0 then ' pro' when 1 then ' 16' else ' m4' end, ' on amazon') as raw from {d.table('part')}"
    asked = f"select raw, {rank.product_query(d, 'raw')} as clean from (select distinct raw from ({raws}) r) u"
    facts = f"select *, {rank.product_words(d, 'clean')} as ws from ({asked}) a"
    facts = f"select *, {rank.discriminators(d, 'ws')} as ds from ({facts}) f"
    run = lambda x: d.extract(x, "[A-Za-z0-9_]+", 0)
    query_words = f"select distinct raw, word, {run('word')} as k, least(2, {d.size('ws')}) as need from ({facts}) q {d.each('ws', 'word')}"
    card_words = f"select distinct card, t, sponsored, cart, word as k from (select *, {d.extract_all('t', '[A-Za-z0-9_]+', 0)} as ws from ({cards}) c) x {d.each('ws', 'word')}"
    # The rows are few and the score is dear, so they are dealt out to more tasks than their size asks for.
    spread = "/*+ repartition(64, raw, card) */ " if type(d) is Spark else ""
    near = f"select {spread}raw, card, t, sponsored, cart from ({query_words}) a join ({card_words}) b on a.k = b.k group by raw, card, t, sponsored, cart, need having count(distinct word) >= need"
    scored = f"select n.raw, q.clean, n.card, {rank.product_score(d, 'n.t', 'q.clean', 'q.ws', 'q.ds', 'n.sponsored', 'n.cart')} as score from ({near}) n join ({facts}) q on q.raw = n.raw"
    best = f"select * from (select *, row_number() over (partition by raw order by score desc, card) as r from ({scored}) s where score > 0) t where r = 1"
    return f"select p_partkey as query_id, clean, card as best, score from ({raws}) p join ({best}) b on b.raw = p.raw"


def media(d: Spark) -> str:
    titles = f"select p_partkey as id, trim({chain(d, 'lower(concat(p_name, chr(32), p_type, chr(32), p_brand))', (r'[^a-z0-9_\s]', ' '), (r'\s+', ' '))}) as t, p_partkey % 11 = 0 as ad from {d.table('part')}"
    asked = values(d, "query_id, raw", ((1, "play small ring on spotify"), (2, "watch the video large steel by brand please"), (3, 'play "blue box" song'), (4, "listen to red"), (5, "play it")))
    facts = f"select *, {rank.media_words(d, 'clean')} as ws from (select *, {rank.media_query(d, 'raw')} as clean from {asked} a) b"
    return f"select query_id, id, score from (select query_id, id, {rank.media_score(d, 't', 'clean', 'ws', 'ad')} as score from ({facts}) q cross join ({titles}) t) s where score <> 0"


def fields(d: Spark) -> str:
    combined = "lower(concat(name, ' ', id, ' ', placeholder, ' ', aria, ' ', role))"
    inner = f"select *, {combined} as c, concat(name, ' ', id, ' ', placeholder, ' ', aria) as labels from {values(d, COLUMNS, FIELDS)} f"
    return f"select el_id, {act.element_category(d, 'c', 'tag', 'type', 'name', 'role', 'value', 'labels')} as element_category, {act.dom_category(d, 'c', 'type', 'name', 'role', 'value')} as dom_category, {act.search_field('c', 'type', 'name', 'role')} as is_search, {p.sensitive(d, ('name', 'id', 'placeholder', 'aria'), 'type', 'value')} as is_sensitive from ({inner}) t"


def segmented(d: Spark) -> str:
    """Groups of single-character inputs: 4 to 8 are one code. Groups are the orders' lines."""
    return f"select l_orderkey as page_id, cast(l_linenumber as int) as el_id, count(*) over (partition by l_orderkey) between 4 and 8 as is_code from {d.table('lineitem')}"


def autofill(d: Spark) -> str:
    rows = f"select el_id, {act.vault_field(d, 'descriptor', 'type')} as field from (select *, lower(concat(name, ' ', id, ' ', placeholder, ' ', aria, '  ', type)) as descriptor from {values(d, COLUMNS, FIELDS)} f) t"
    return f"select el_id, r.field, v.value, {act.audit_value('v.value')} as audit from ({rows}) r join {values(d, 'field, value', VAULT)} v on v.field = r.field"


_ELEMENT_TEXT = "lower(concat(text, ' ', aria, ' ', placeholder, ' ', id, ' ', name))"


def plan_offline(d: Spark) -> str:
    """One action for each goal: navigate, autofill, the best element, scroll or finish."""
    table = values(d, "goal_id, text, url", GOALS)
    scored = f"select goal_id, g.text as goal, idx, tag, selector, {rank.plan_score(d, 'goal', 'combined', 'e.text', 'tag')} as score from (select goal_id, lower(text) as goal, text from {table} x) g cross join (select *, {_ELEMENT_TEXT} as combined from {values(d, EL_COLUMNS, ELEMENTS)} y) e"
    best = f"select * from (select *, row_number() over (partition by goal_id order by score desc, idx) as r from ({scored}) s where score > 0) b where r = 1"
    inner = f"select t.goal_id, t.text, b.idx, b.tag, b.selector, {act.plan_target(d, 't.text')} as place, {d.match('t.text', g.AUTOFILL)} as fill, contains(lower(t.text), 'scroll') as scroll from {table} t left join ({best}) b on b.goal_id = t.goal_id"
    return f"""select goal_id, case when place <> '' then 'navigate' when fill then 'autofill' when idx is not null then case when tag in ('input', 'textarea') then 'type' else 'click' end when scroll then 'scroll' else 'finish' end as action,
      case when place <> '' then place when fill then null when idx is not null and tag in ('input', 'textarea') then {g.query_py(d, 'text')} end as value, case when place = '' and not fill then idx end as target_index, case when place = '' and not fill then selector end as selector,
      cast(case when place <> '' or fill then 0.95 when idx is not null then case when tag in ('input', 'textarea') then 0.88 else 0.90 end when scroll then 0.85 else 0.75 end as double) as confidence from ({inner}) q"""


def safety(d: Spark) -> str:
    """What an action needs: its target by index, else by text, and a confirmation."""
    low = "lower(concat(e.text, ' ', e.aria, ' ', e.id, ' ', e.name))"
    wanted = "lower(trim(a.target_text))"
    hit = f"(a.target_index = e.idx or (a.target_index < 0 and a.target_text <> '' and (contains({low}, {wanted}) or contains({wanted}, lower(e.text)))))"
    ranked = f"select a.*, e.idx, e.text, e.aria, e.id, e.name, e.is_sensitive, row_number() over (partition by action_id order by e.idx) as r from {values(d, 'action_id, action, target_index, target_text, thought', ACTIONS)} a left join {values(d, EL_COLUMNS, ELEMENTS)} e on {hit}"
    joined = "concat(target_text, ' ', coalesce(text, ''), ' ', coalesce(aria, ''), ' ', coalesce(id, ''), ' ', coalesce(name, ''), ' ', thought)"
    free = f"action in ('finish', 'wait', 'scroll')"
    return f"select action_id, action, case when {free} then null else idx end as element, not {free} and (coalesce(is_sensitive, false) or {act.critical(d, joined)}) as confirm, case when {free} then 'safe' when coalesce(is_sensitive, false) then 'sensitive' when {act.critical(d, joined)} then 'critical' else 'safe' end as verdict from ({ranked}) t where r = 1"


def patch_grid(d: Spark) -> str:
    """Sampled patches of a 14 by 14 grid over a 224 px square, labelled by number."""
    seq = "select explode(sequence(1, 11, 2))" if type(d) is Spark else "select unnest(generate_series(1, 11, 2))"
    return f"select cast(y * 14 + x as int) as patch, cast(x * 16 as int) as px, cast(y * 16 as int) as py, cast((y * 14 + x) % 7 as int) as kind from ({seq} as x) a cross join ({seq} as y) b"


def mission(d: Spark) -> str:
    """Each user's events as the steps of a mission: counts, progress and its length."""
    done = "event_type <> 'error'"
    count = lambda t: f"cast(sum(case when {t} then 1 else 0 end) as bigint)"
    return f"select user_id, count(*) as steps, {count(done)} as completed, {count('event_type = ' + d.lit('error'))} as failed, cast(floor({count(done)} * 100.0 / count(*) + 0.5) as int) as percent, round(sum(value), 4) as total from {d.table('events')} group by user_id"


MAKERS = {
    "page_links": (page_links, "pages"), "page_text": (page_text, "pages"), "deep_search": (deep_search, "pages"), "element_cap": (element_cap, "pages"), "product_rank": (products, "part"), "media_rank": (media, "part"),
    "classify_fields": (fields,), "segmented_otp": (segmented, "lineitem"), "autofill": (autofill,), "plan_offline": (plan_offline,), "action_safety": (safety,), "patch_grid": (patch_grid,), "mission_summary": (mission, "events"),
}
QUERIES = {k: query(make, *tables) for k, (make, *tables) in MAKERS.items()}
SQL = {k: make(Duck()) for k, (make, *_) in MAKERS.items()}
