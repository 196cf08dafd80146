"""Queries for where entities, cards, search fields and videos stand on pages, and their SQL, which finds them on the
tree of the recursive walk (plans/trees.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakwork.functions import checks
from cloakwork.operators import places, redact
from cloakwork.plans import detection, duck, trees
from cloakwork.sources import forms, shops

KEYS = ("src", "page_id")
_SHOPS = trees.TREE_CTES.replace(forms.ALL_SQL, shops.ALL_SQL)
#: Texts of pages that keep their footers.
_WITH_FOOTERS = lambda ctes: ctes.replace("where m.footer or m.unshown or", "where m.unshown or")
_A = trees.attribute


def entity_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.entity_places(forms.all_pages(spark, sf_dir), *KEYS).select(*KEYS, "pos", "category", "value", "place", "offset")


_ENTITIES = detection.ENTITY_CTES.replace(detection.CORPUS, "select src, page_id as doc_id, text from bodies")
_BARRED = "list_contains(['h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'label', 'th', 'thead'], n.tag) or h.heading"
_BRANDED = f"{duck.trim('lower(t.t)')} in {duck.words(checks.BRAND_WORDS)}"
PLACES_SQL = f"""with recursive {_WITH_FOOTERS(trees.TREE_CTES)},
    bodies as (select s.src, s.page_id, {trees.plain("coalesce(string_agg(x.x, '' order by x.i), '')")} as text from source s left join said x using (src, page_id) group by all), {_ENTITIES},
    heading as (select a.src, a.page_id, a.i, bool_or(n.tag in ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') or {_A('role', 'n.names, n.vals')} = 'heading' or regexp_matches({_A('class', 'n.names, n.vals')}, '(^|\\s)(badge|card-header)(\\s|$)')) as heading from anc a join node n on n.src = a.src and n.page_id = a.page_id and n.i = a.a group by all),
    wanted as (select src, doc_id as page_id, cast(pos as int) as pos, category, value, lower(value) as v, category = 'NAME' or length(value) < 2 or {duck.trim('lower(value)')} in {duck.words(checks.BRAND_WORDS)} or {duck.like('lower(value)', redact.EXEMPT)} or (category = 'ADDRESS' and {duck.like('lower(value)', places.NOT_PLACES)}) as exempt from masked),
    asked as (select distinct src, page_id from wanted),
    whole as materialized (select n.src, n.page_id, n.i, {trees.plain("string_agg(x.x, '' order by x.i)")} as t from asked join node n using (src, page_id) join closed c using (src, page_id, i) join said x on x.src = n.src and x.page_id = n.page_id and x.i > n.i and x.i <= c.last where n.tag not in ('html', 'body') group by all),
    usable as materialized (select n.src, n.page_id, n.i, n.tag, not ({_BARRED}) and not coalesce({_BRANDED}, false) as ok from node n join heading h using (src, page_id, i) left join whole t using (src, page_id, i)),
    runs as (select t.src, t.page_id, t.i, lower(s.x) as t from asked join tk t using (src, page_id) join said s using (src, page_id, i) join walk w using (src, page_id, i) left join usable u on u.src = t.src and u.page_id = t.page_id and u.i = w.ids[-1] where t.kind = 'text' and coalesce(u.ok, true)),
    kids as (select distinct src, page_id, parent as i from node),
    leaves as (select u.src, u.page_id, u.i, lower(t.t) as t from usable u join whole t using (src, page_id, i) left join kids k using (src, page_id, i) where ok and k.i is null and u.tag in ('p', 'span', 'div', 'td', 'th', 'li', 'strong', 'b', 'code')),
    fields as (select n.src, n.page_id, n.i, lower({duck.trim("case when n.tag = 'textarea' then coalesce(c.content, '') else " + _A('value', 'n.names, n.vals') + " end")}) as t from node n join inside s using (src, page_id, i)
      left join (select a.src, a.page_id, a.id as i, string_agg({trees.decoded('t.x')}, '' order by t.i) as content from open_at a join tk t using (src, page_id, i) where t.kind = 'text' group by all) c using (src, page_id, i) where n.tag in ('input', 'textarea') and not s.unshown),
    spots as (select w.src, w.page_id, pos, 1 as k, 'text' as place, arg_min(instr(r.t, v) - 1, r.i) as o from wanted w join runs r using (src, page_id) where contains(r.t, v) group by all
      union all select w.src, w.page_id, pos, 2, 'leaf', null from wanted w join leaves r using (src, page_id) where contains(r.t, v) group by all
      union all select w.src, w.page_id, pos, 3, 'field', null from wanted w join fields f using (src, page_id) where length(f.t) >= 3 and length(v) >= 3 and (contains(f.t, v) or contains(v, f.t)) group by all),
    best as (select src, page_id, pos, arg_min(place, k) as place, arg_min({{'o': o}}, k).o as o from spots group by all)
    select w.src, w.page_id, w.pos, category, value, case when exempt then 'exempt' else coalesce(place, 'none') end as place, cast(case when not exempt then o end as int) as "offset" from wanted w left join best using (src, page_id, pos)"""


def structural_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.structural_cards(shops.pages(spark, sf_dir), *KEYS).select(*KEYS, "card", "text")


CARDS_SQL = f"""with recursive {_WITH_FOOTERS(_SHOPS)},
    whole as (select n.src, n.page_id, n.i, {trees.plain("string_agg(x.x, '' order by x.i)")} as t from node n join inside s using (src, page_id, i) join closed c using (src, page_id, i) join said x on x.src = n.src and x.page_id = n.page_id and x.i > n.i and x.i <= c.last where n.tag in ('div', 'article', 'li', 'a') and not s.unshown group by all),
    held as (select a.src, a.page_id, a.a as i, bool_or(n.tag = 'img') as pictured, bool_or(n.tag = 'a') as linked from anc a join node n using (src, page_id, i) where a.a <> a.i group by all),
    cards as (select w.* from whole w join held h using (src, page_id, i) join node n using (src, page_id, i) where regexp_matches(t, {duck.q('(?i)' + places.PRICE)}) and pictured and (n.tag = 'a' or linked)),
    outer_cards as (select c.* from cards c where not exists (select 1 from anc a join cards o on o.src = a.src and o.page_id = a.page_id and o.i = a.a where a.src = c.src and a.page_id = c.page_id and a.i = c.i and a.a <> c.i))
    select src, page_id, cast(row_number() over (partition by src, page_id order by i) - 1 as int) as card, t as text from outer_cards"""


def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.search_fields(shops.pages(spark, sf_dir), *KEYS).select(*KEYS, "pass", "rank", "selector", "opener")


#: Of the page's kinds of fields, worked out by hand: what each kind of derived page has.
SEARCH_SQL = """select 'shops' as src, p_partkey as page_id, cast(case p_partkey % 6 when 0 then 1 when 1 then 1 when 2 then 1 when 3 then 3 end as int) as pass,
      cast(case p_partkey % 6 when 0 then 43 when 1 then 12 when 2 then 40 end as int) as rank, case p_partkey % 6 when 0 then '#top' when 1 then 'input[name="q"]' when 2 then 'input[name="u' || p_partkey || '"]' else 'textarea[name="note"]' end as selector,
      case when p_partkey % 6 = 3 then '#open' end as opener from part where p_partkey % 6 < 4"""


def media_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.media_candidates(shops.pages(spark, sf_dir), *KEYS)


MEDIA_SQL = f"""with recursive {_WITH_FOOTERS(_SHOPS)},
    links as (select n.src, n.page_id, n.i, {_A('href')} as href, {_A('title')} as title, {_A('aria-label')} as label from node n join inside s using (src, page_id, i) where n.tag = 'a' and contains({_A('href')}, '/watch?v=') and not s.unshown),
    texts as (select l.src, l.page_id, l.i, string_agg(x.x, '' order by x.i) as t from links l join closed c using (src, page_id, i) join said x on x.src = l.src and x.page_id = l.page_id and x.i > l.i and x.i <= c.last group by all),
    keyed as (select src, page_id, l.i, href, case when regexp_extract(href, '[?&]v=([a-zA-Z0-9_-]+)', 1) <> '' then regexp_extract(href, '[?&]v=([a-zA-Z0-9_-]+)', 1) else href end as watch_key,
      list_filter([{trees.plain('title')}, {trees.plain('label')}, {trees.plain("coalesce(t, '')")}], lambda x: length(x) >= 2 and not regexp_matches(x, '^\\d+:\\d+(:\\d+)?$'))[1] as title from links l left join texts using (src, page_id, i)),
    one as (select src, page_id, watch_key, min(i) as i, arg_min(href, i) as href, arg_min(title, i) filter (title is not null) as title from keyed group by all)
    select src, page_id, cast(row_number() over (partition by src, page_id order by i) - 1 as int) as pos, watch_key, href, title from one where title is not null"""

QUERIES = {"entity_places": entity_places, "structural_cards": structural_cards, "search_fields": search_fields, "media_candidates": media_candidates}
SQL = {"entity_places": PLACES_SQL, "structural_cards": CARDS_SQL, "search_fields": SEARCH_SQL, "media_candidates": MEDIA_SQL}
