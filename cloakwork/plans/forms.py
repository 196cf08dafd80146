"""Queries over the interactive elements of pages, and their SQL, written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions import checks
from cloakwork.functions.dialect import Duck, Spark
from cloakwork.operators import act, goals
from cloakwork.operators import elements as el
from cloakwork.plans import duck, trees
from cloakwork.sources import forms

KEYS = ("src", "page_id")
#: Terms, goals and options asked for, dealt to the pages by their numbers.
TERMS = ("click on Track parcel", "three here", "parcel on its way", "None", "find in", "go to cart", "Proceed to checkout button", "open the wish list", "orders of my page", "see details", "pro model 12", "nothing like it", "", "city", "my cart here", "More offers and details")
ASKS = ("go back please", "open irctc", "auto fill my details", "scroll to top", "press ESC now", "show my orders", "search for blue ring", "click the Model 12 Pro card", "select city", "tap More offers", "dance", "press enter", "next page", "wish list", "find the notes in here", "visit news.site.com")
OPTIONS = ("pune", "DEL", " new ", "Town", "nowhere")
#: More elements than a page has.
EVERY = 1 << 30


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.elements(forms.all_pages(spark, sf_dir), *KEYS)


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).select(*KEYS, "idx", "tag", "text", "aria", "placeholder", "type", "id", "name", "selector", "is_sensitive")


def _cases(rows: tuple, at: int = 0) -> str:
    quoted = lambda v: "null" if v is None else duck.q(v)
    return f"case page_id % {len(rows)} " + " ".join(f"when {i} then {quoted(r[at] if isinstance(r, tuple) else r)}" for i, r in enumerate(rows)) + " end"


#: CTEs up to ``el``: the elements of each page.
ELEMENT_CTES = trees.ELEMENT_CTES
ELEMENTS_SQL = f"with recursive {ELEMENT_CTES} select src, page_id, idx, tag, text, aria, placeholder, type, id, name, selector, is_sensitive from el"


def otp_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.code_groups(forms.all_pages(spark, sf_dir), *KEYS)


_CELL = f"tag = 'input' and ({trees.attribute('maxlength')} = '1' or {trees.attribute('size')} = '1' or contains({trees.attribute('pattern')}, '0-9'))"
_ROW = f"regexp_matches({trees.attribute('class')} || ' ' || {trees.attribute('id')}, '(?i)otp-row') or regexp_matches({trees.attribute('class')}, '(?i)otp-input|code-inputs')"
OTP_SQL = f"""with recursive {trees.TREE_CTES},
    cells as (select n.*, {duck.trim(trees.attribute('value'))} as v, not s.unshown and not s.footer as usable from node n join inside s using (src, page_id, i)),
    lone as (select src, page_id, count(*) as n, string_agg(case when v = '' then '•' else v end, '' order by i) filter (usable) as code, count(*) filter (usable) as cells from cells where {_CELL} group by all),
    held as (select c.src, c.page_id, anc.a, count(*) as n, string_agg(case when v = '' then '•' else v end, '' order by c.i) filter (usable) as code, count(*) filter (usable) as cells
      from cells c join anc using (src, page_id, i) join (select src, page_id, i as a from node where {_ROW}) r using (src, page_id, a) where c.tag = 'input' and anc.a <> c.i group by all)
    select src, page_id, cast(cells as int) as cells, code from lone where n between 4 and 8 and cells > 0
    union all select src, page_id, cast(h.cells as int), h.code from held h left join lone l using (src, page_id) where h.n between 4 and 8 and h.cells > 0 and coalesce(l.n, 0) not between 4 and 8"""


def leaf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.leaf_findings(forms.all_pages(spark, sf_dir), *KEYS)


_CARD = "regexp_extract(leaf, '\\b(?:\\d{4}[-\\s]?){3}\\d{4}\\b|\\b(?:\\d{4}[-\\s]?){2}\\d{4}[-\\s]?\\d{3}\\b')"
_UID = "regexp_extract(leaf, '\\b[2-9]\\d{3}[-\\s]?\\d{4}[-\\s]?\\d{4}\\b')"
_PLACE = "coalesce(nullif(regexp_extract(leaf, '(?i)\\b(?:delivering|deliver(?:y)?|ship(?:ping)?|send)\\s+(?:to|in|at)\\s+([A-Za-z\\s,-]{2,35}?\\s+\\b[1-9][0-9]{5}\\b)', 1), ''), regexp_extract(leaf, '\\b([A-Z][a-zA-Z\\s]{2,20}\\s+\\b[1-9][0-9]{5}\\b)', 1))"
_DIGITS = "regexp_replace(card, '[^0-9]', '', 'g')"
LEAF_SQL = f"""with clean as (select src, page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'), '(?is)<footer\\b[^>]*>.*?</footer\\s*>', '', 'g') as h from ({forms.ALL_SQL}) r),
    leaves as (select src, page_id, regexp_extract_all(h, {duck.q(el.LEAF)}, 1) as ls from clean),
    leaf as (select src, page_id, unnest(generate_series(0, len(ls) - 1)) as pos, {duck.trim('unnest(ls)')} as leaf from leaves),
    found as (select src, page_id, cast(pos as int) as pos, {_CARD} as card, {_UID} as uid, regexp_extract(leaf, '\\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\\b') as pan, {duck.trim(_PLACE)} as place from leaf where length(leaf) between 8 and 80)
    select src, page_id, pos, 'CARD' as category, card as value, 'HIGH' as risk from found where length({_DIGITS}) between 13 and 19 and ({duck.luhn(_DIGITS)} or regexp_matches({_DIGITS}, {duck.q(el.CARD_BRANDS)}))
    union all select src, page_id, pos, 'AADHAAR', uid, 'HIGH' from found where uid <> '' and {duck.verhoeff('uid')}
    union all select src, page_id, pos, 'PAN', pan, 'HIGH' from found where pan <> ''
    union all select src, page_id, pos, 'ADDRESS', place, 'MEDIUM' from found where place <> '' and not regexp_matches(lower(place), {duck.q('(?i)' + el.NO_ADDRESS)}) and not regexp_matches(lower(place), {duck.q('(?i)' + el.NOT_ADDRESS)}) and lower(place) not in {duck.words(checks.BRAND_WORDS)}"""


def _asked(spark: SparkSession, sf_dir: str, rows: tuple, name: str) -> DataFrame:
    """The pages, with one of the rows for each."""
    return forms.all_pages(spark, sf_dir).withColumn(name, F.get(F.array(*map(F.lit, rows)), F.pmod("page_id", F.lit(len(rows))).cast("int")))


def smart_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.smart_lookup(_asked(spark, sf_dir, TERMS, "term"), *KEYS).select(*KEYS, "selector", "pass", "score")


_WORDS = "list_filter(list_transform(string_split_regex(clean, '[\\s,_\\-—/|]+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) >= 2 and w not in ('the', 'and', 'for', 'with', 'this', 'that'))"
_NAMED = f"tag in ('button', 'a', 'select', 'label', 'summary') or (tag = 'input' and {trees.attribute('type')} in ('button', 'submit')) or {trees.attribute('role')} in ('button', 'tab', 'link', 'menuitem') or list_contains(names, 'onclick') or regexp_matches({trees.attribute('class')}, '(^|\\s)btn(\\s|$)') or list_contains(names, 'tabindex')"
_AROUND = f"tag in ('button', 'a', 'label', 'li', 'tr') or {trees.attribute('role')} in ('button', 'tab', 'link') or list_contains(names, 'onclick') or regexp_matches({trees.attribute('class')}, '(^|\\s)btn(\\s|$)')"
#: The look-up reads footers too, so its text is that of all that is shown.
_LOOKUP_TREE = trees.TREE_CTES.replace("where m.footer or m.unshown or", "where m.unshown or")
LOOKUP_SQL = f"""with recursive {_LOOKUP_TREE},
    asked as (select src, page_id, {duck.trim(_cases(TERMS))} as raw from source),
    stripped as (select *, lower({duck.trim(f"regexp_replace(regexp_replace(regexp_replace(raw, {duck.q('(?i)' + el.LOOKUP_VERBS)}, '', 'g'), {duck.q('(?i)' + el.LOOKUP_NOUNS)}, '', 'g'), '\\s+', ' ', 'g')")}) as c from asked where raw <> ''),
    term as (select src, page_id, lower(raw) as asked, case when c <> '' then c else lower(raw) end as clean from stripped),
    tw as (select *, {_WORDS} as ws from term),
    seen as materialized (select n.src, n.page_id, n.i, n.parent, n.tag, n.names, n.vals, ({_NAMED}) as named, ({_AROUND}) as around, tag in ('h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'strong', 'b', 'span', 'p', 'div', 'li', 'td', 'tr') as texty from node n join inside s using (src, page_id, i) where not s.unshown),
    told as (select u.src, u.page_id, u.i, string_agg(x.x, '' order by x.i) as t from seen u join closed c using (src, page_id, i) join said x on x.src = u.src and x.page_id = u.page_id and x.i > u.i and x.i <= c.last where u.named or u.texty group by all),
    kids as (select src, page_id, parent as i, count(*) as children from node group by all),
    facts as materialized (select s.src, s.page_id, s.i, s.tag, s.named, s.texty, coalesce(children, 0) as children, lower({trees.plain("coalesce(t, '')")}) as t, lower(trim({trees.attribute('aria-label')})) as a, lower(trim({trees.attribute('title')})) as ti, lower(trim({trees.attribute('id')})) as d, lower(trim({trees.attribute('name')})) as n, lower(trim({trees.attribute('href')})) as hr,
      lower(case when tag in ('input', 'button') then {trees.attribute('value')} else '' end) as v, asked, clean, ws from seen s join tw using (src, page_id) left join told using (src, page_id, i) left join kids using (src, page_id, i) where s.named or s.texty),
    counted as (select *, t || ' ' || a || ' ' || ti || ' ' || v || ' ' || d || ' ' || n as combined, string_split_regex(clean, '\\s+') as cs from facts where named),
    scored as (select *, len(list_filter(ws, lambda w: contains(combined, w))) as hits, case when len(ws) > 0 then len(list_filter(ws, lambda w: contains(combined, w))) * 100.0 / len(ws) - case when length(combined) > 150 then 20 else 0 end else 0 end as score from counted),
    named_passes as (select src, page_id, i, case
      when asked in ('cart', 'go to cart', 'open cart') and (d in ('nav-cart', 'btn-nav-cart') or (tag = 'a' and contains(hr, 'cart')) or (tag = 'button' and contains(d, 'cart'))) then 0
      when t = clean or a = clean or ti = clean or v = clean then 1
      when (t <> '' and (contains(t, clean) or (length(t) >= 4 and list_contains(cs, t)))) or (a <> '' and (contains(a, clean) or (length(a) >= 4 and list_contains(cs, a)))) or (ti <> '' and contains(ti, clean)) or (v <> '' and contains(v, clean)) then 2
      when hits > 0 and score >= 35 then 3
      when len(list_filter(ws, lambda w: contains(d, w) or contains(n, w) or contains(hr, w))) > 0 then 5 end as pass, score from scored),
    hit as (select src, page_id, min(i) as i from facts where texty and children <= 6 and (t <> '' or a <> '') and (t = clean or a = clean or (length(t) < 120 and contains(t, clean)) or (len(ws) >= 2 and len(list_filter(ws, lambda w: not contains(t, w))) = 0)) group by all),
    placed as (select h.src, h.page_id, coalesce(max(a.a) filter (s.around), any_value(h.i)) as i, 4 as pass, 0.0 as score from hit h join anc a using (src, page_id, i) join seen s on s.src = h.src and s.page_id = h.page_id and s.i = a.a group by all),
    passes as (select * from named_passes where pass is not null union all select * from placed),
    best as (select * from passes qualify row_number() over (partition by src, page_id order by pass, case when pass = 3 then -score else 0 end, i) = 1),
    steps as (select src, page_id, i as a, tag, tag || case when regexp_matches({trees.attribute('class')}, '^\\s*[^\\s:/]+(\\s|$)') then '.' || regexp_extract({trees.attribute('class')}, '^\\s*([^\\s:/]+)', 1) else '' end
      || case when count(*) over (partition by src, page_id, parent, tag) > 1 then ':nth-of-type(' || row_number() over (partition by src, page_id, parent, tag order by i) || ')' else '' end as step from node),
    paths as (select b.src, b.page_id, string_agg(s.step, ' > ' order by s.a) as path from best b join anc using (src, page_id, i) join steps s on s.src = b.src and s.page_id = b.page_id and s.a = anc.a where s.tag not in ('body', 'html') group by all)
    select b.src, b.page_id, case when {trees.attribute('id')} <> '' then '#' || {trees.attribute('id')} when {trees.attribute('name')} <> '' then n.tag || '[name="' || {trees.attribute('name')} || '"]' when {trees.attribute('aria-label')} <> '' then n.tag || '[aria-label="' || replace({trees.attribute('aria-label')}, ' ', '\\ ') || '"]'
      when {trees.attribute('role')} <> '' then n.tag || '[role="' || {trees.attribute('role')} || '"]' else path end as selector, cast(pass as int) as pass, round(case when pass = 3 then score else 0 end, 6)::double as score
    from best b join node n using (src, page_id, i) left join paths using (src, page_id)"""


def select_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.get(F.array(*map(F.lit, OPTIONS)), F.pmod("page_id", F.lit(len(OPTIONS))).cast("int"))
    return el.chosen_option(el.elements(forms.all_pages(spark, sf_dir), *KEYS, most=EVERY), wanted, *KEYS)


OPTION_SQL = f"""with recursive {ELEMENT_CTES.replace('where idx < 60', '')},
    asked as (select src, page_id, lower({duck.trim(_cases(OPTIONS))}) as w from source),
    fits as (select e.src, e.page_id, e.idx, o.o, o.value, row_number() over (partition by e.src, e.page_id, e.idx order by o.o) as r from el e join option_of o using (src, page_id, i) join asked a using (src, page_id) where lower(o.value) = w or contains(lower(o.label), w))
    select src, page_id, idx, cast(o as int) as "option", value from fits where r = 1"""


def _understood(d: Spark) -> tuple[str, str]:
    """Where a goal navigates, and what it searches for."""
    return f"{goals.navigation(d, 'goal')} as nav", f"{goals.query_ts(d, 'goal')} as query"


def plan_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir, ASKS, "goal").selectExpr(*KEYS, "goal", *_understood(Spark()))
    return el.plan_client(asked, _elements(spark, sf_dir), "nav", "query", *KEYS)


_HAS = lambda p: f"regexp_matches(goal, {duck.q('(?i)' + p)})"
CLIENT_SQL = f"""with recursive {ELEMENT_CTES},
    asked as (select src, page_id, goal, {', '.join(_understood(Duck()))} from (select src, page_id, {_cases(ASKS)} as goal from source) s),
    w1 as (select *, list_filter(string_split_regex(lower({duck.trim(f"regexp_replace(goal, {duck.q('(?i)' + el.PLAN_WORDS)}, ' ', 'g')")}), '\\s+'), lambda w: length(w) >= 2 and w not in ('for', 'and', 'with', 'this', 'that')) as ws from asked),
    j as (select w1.*, e.idx, e.tag, e.id, e.name, e.placeholder, e.text || ' ' || e.aria || ' ' || e.id as label, lower(e.text || ' ' || e.aria || ' ' || e.id || ' ' || e.name) as combined from w1 left join el e using (src, page_id)),
    s as (select *, contains(lower(goal), 'order') and regexp_matches(label, '(?i){el.ORDERS}') as is_order, regexp_matches(lower(goal), 'search|type|find') and tag = 'input' and regexp_matches(id || ' ' || name || ' ' || placeholder, '(?i)search|input|query|text|q') as is_search,
      case when len(ws) = 0 or len(list_filter(ws, lambda w: regexp_matches(w, '[0-9]') and not regexp_matches(combined, '(?:^|[^a-z0-9])' || w || '(?:$|[^a-z0-9])'))) > 0 then 0.0 else len(list_filter(ws, lambda w: contains(combined, w))) * 100.0 / len(ws) end as score from j),
    a as (select src, page_id, any_value(goal) as goal, any_value(nav) as nav, any_value(query) as query, min(idx) filter (is_order) as o, min(idx) filter (is_search) as f, max(score) as top from s group by src, page_id),
    b as (select src, page_id, min(idx) as idx, arg_min(tag, idx) as tag from s join a using (src, page_id) where score = top and top >= 50 group by src, page_id),
    k as (select a.*, b.idx, b.tag, case when {_HAS(el.BACK)} then 1 when {_HAS(el.FORWARD)} then 2 when nav is not null then 3 when {_HAS(el.FILL)} then 4 when {_HAS(el.SCROLL)} then 5 when {_HAS(el.PRESS)} then 6 when o is not null then 7 when f is not null then 8 when b.idx is not null then 9 else 10 end as r from a left join b using (src, page_id))
    select src, page_id, case r when 1 then 'navigate' when 2 then 'navigate' when 3 then 'navigate' when 4 then 'autofill' when 5 then 'scroll' when 6 then 'press_key' when 7 then 'click' when 8 then 'type' when 9 then case when tag = 'select' then 'select' else 'click' end else 'finish' end as action,
      case r when 1 then 'history:back' when 2 then 'history:forward' when 3 then nav when 5 then coalesce(nullif(lower(regexp_extract(goal, '(?i)\\b(down|up|top|bottom)\\b', 1)), ''), 'down') when 6 then case lower(regexp_extract(goal, '(?i)\\b(enter|tab|escape|esc|backspace)\\b', 1)) when 'enter' then 'Enter' when 'tab' then 'Tab' when 'backspace' then 'Backspace' else 'Escape' end when 8 then query end as value,
      cast(case r when 7 then o when 8 then f when 9 then idx end as int) as idx from k"""


def prompt_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.prompt_lines(el.elements(forms.all_pages(spark, sf_dir), *KEYS, most=el.PROMPT_MOST), *KEYS)


PROMPT_SQL = f"""with recursive {ELEMENT_CTES.replace('where idx < 60', 'where idx < 120')},
    ranked as (select *, cast(row_number() over (partition by src, page_id order by case when tag in ('button', 'input', 'select') or contains(lower(selector), 'btn') then 0 else 1 end, idx) as int) as pos from el)
    select src, page_id, pos, '[' || idx || '] <' || tag || '> ' || chr(39) || substr({duck.trim("case when text <> '' then text when aria <> '' then aria when placeholder <> '' then placeholder when id <> '' then id when name <> '' then name else '(unlabeled)' end")}, 1, 90) || chr(39) || ' (selector: ' || selector || ')' as line from ranked where pos <= 60"""


def _field_columns(d: Spark) -> tuple[str, ...]:
    """What a field is by its names and value, in the dialect's words."""
    return (f"{act.element_category(d, 'c', 'tag', 'type', 'name', 'role', 'value', 'labels')} as element_category", f"{act.dom_category(d, 'c', 'type', 'name', 'role', 'value')} as dom_category", f"{act.search_field('c', 'type', 'name', 'role')} as is_search", f"{act.vault_field(d, 'descriptor', 'type')} as vault_field")


_NAMES = ("lower(concat(name, ' ', id, ' ', placeholder, ' ', aria, ' ', role)) as c", "concat(name, ' ', id, ' ', placeholder, ' ', aria) as labels", "lower(concat(name, ' ', id, ' ', placeholder, ' ', aria, '  ', type)) as descriptor")


def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of every page, what they hold and what the vault would fill in."""
    found = _elements(spark, sf_dir).where("tag in ('input', 'textarea', 'select')")
    return found.selectExpr("*", *_NAMES).selectExpr(*KEYS, "idx", *_field_columns(Spark()))


FIELDS_SQL = f"""with recursive {ELEMENT_CTES}, fields as (select *, {', '.join(_NAMES)} from el where tag in ('input', 'textarea', 'select'))
    select src, page_id, idx, {', '.join(_field_columns(Duck()))} from fields"""

QUERIES = {"prompt_elements": prompt_elements, "page_fields": page_fields, "page_elements": page_elements, "otp_groups": otp_groups, "leaf_scan": leaf_scan, "smart_lookup": smart_lookup, "select_option": select_option, "plan_client": plan_client}
SQL = {"prompt_elements": PROMPT_SQL, "page_fields": FIELDS_SQL, "page_elements": ELEMENTS_SQL, "otp_groups": OTP_SQL, "leaf_scan": LEAF_SQL, "smart_lookup": LOOKUP_SQL, "select_option": OPTION_SQL, "plan_client": CLIENT_SQL}
