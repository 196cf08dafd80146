"""Pages as trees in DuckDB's SQL, found another way than the operator: a recursive query walks all
pages' tokens step by step and keeps the open tags as lists; intervals, ancestors and texts follow from joins.

It reads tags without '>' in attributes, the references that the pages hold, and areas and kinds
as regular expressions on a tag's attributes.
"""

from __future__ import annotations

from cloakwork.functions import tree
from cloakwork.plans import duck
from cloakwork.sources import forms, pages

_NAMES = lambda ts: duck.q("|" + "|".join(ts) + "|")
_RULES = ", ".join(f"({duck.q(t)}, {_NAMES(a)}, {_NAMES(b)})" for t, (a, b) in tree.ENDS.items())
_LAST = lambda tags, names: f"coalesce(list_max(list_transform(generate_series(1, len({tags})), lambda k: case when contains({names}, '|' || {tags}[k] || '|') then k else 0 end)), 0)"
_CUT = lambda tags, names, barriers: f"case when {_LAST(tags, names)} > {_LAST(tags, barriers)} then {_LAST(tags, names)} - 1 else len({tags}) end"
_CELLS = _NAMES(tree.CELL)


def _emptied(x: str, *names: str) -> str:
    for name in names:
        x = f"regexp_replace({x}, '(?is)(<{name}\\b[^>]*>).*?</{name}\\s*>', '\\1</{name}>', 'g')"
    return x


def decoded(x: str) -> str:
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, {duck.q(a)}, {duck.q(b)})"
    return x


def attribute(name: str, head: str = "names, vals") -> str:
    """An attribute of a tag whose names and values are lists: the first of the name; empty without it."""
    names, vals = head.split(", ")
    return f"coalesce({vals}[nullif(list_position({names}, {duck.q(name)}), 0)], '')"


#: Recursive CTEs: ``tk`` tokens, ``node`` nodes with ``names`` and ``vals``, ``anc`` node and ancestor (itself included), ``closed`` a node's last token,
#: ``quiet`` tokens under what isn't shown or has no text. To be put after "with recursive".
TREE_CTES = f"""source as (select src, page_id, regexp_replace({_emptied('html', 'script', 'style', 'title', 'noscript')}, '(?s)<!--.*?-->', '', 'g') as h from ({forms.ALL_SQL}) r where html is not null),
    endings(opener, ended, within) as (values {_RULES}),
    toks as (select src, page_id, unnest(generate_series(1, len(xs))) as i, unnest(xs) as x from (select src, page_id, regexp_extract_all(h, '<[^>]*>|[^<]+') as xs from source) s),
    kinds as (select *, case when starts_with(x, '</') then 'end' when starts_with(x, '<!') then 'none' when starts_with(x, '<') then 'open' else 'text' end as kind, lower(regexp_extract(x, '^</?([A-Za-z][^\\s/>]*)', 1)) as tag from toks),
    tk as materialized (select k.*, case when kind = 'open' then coalesce(ended, '') when kind = 'end' and tag not in ('html', 'body') then '|' || tag || '|' else '' end as names,
      case when kind = 'open' then coalesce(within, '') when tag = 'table' then '' when contains({_NAMES(sorted(tree.TABLE_PARTS))}, '|' || tag || '|') then '|table|' else {_CELLS} end as barriers,
      kind = 'open' and contains({_NAMES(sorted(tree.ENDS_P))}, '|' || tag || '|') as ends_p, kind = 'open' and not contains({_NAMES(sorted(tree.IN_HEAD))}, '|' || tag || '|') as leaves_head, contains({_NAMES(sorted(tree.VOID))}, '|' || tag || '|') as void
      from kinds k left join endings on opener = tag and kind = 'open'),
    walk(src, page_id, i, tags, ids, parent) as (select src, page_id, 0::bigint, []::varchar[], []::bigint[], 0::bigint from source
      union all
      select src, page_id, i, case when kind = 'open' and not void then list_append(tags[1:d2], tag) else tags[1:d2] end, case when kind = 'open' and not void then list_append(ids[1:d2], i) else ids[1:d2] end, coalesce(ids[1:d2][-1], 0)
      from (select *, case when names = '' then len(t1) else {_CUT('t1', 'names', 'barriers')} end as d2
        from (select *, tags[1:d1] as t1 from (select *, case when ends_p then {_CUT('t0', "'|p|'", _NAMES((*tree.CELL, 'button', 'object')))} else len(t0) end as d1
          from (select t.src, t.page_id, t.i, t.kind, t.tag, t.names, t.barriers, t.ends_p, t.void, w.tags, w.ids, case when t.leaves_head and w.tags[-1] = 'head' then w.tags[1:len(w.tags) - 1] else w.tags end as t0
            from walk w join tk t on t.src = w.src and t.page_id = w.page_id and t.i = w.i + 1) a) b) c) d),
    heads as (select w.src, w.page_id, w.i, w.parent, w.ids, t.tag, t.void, regexp_extract(t.x, '^<[^\\s/>]+(.*?)/?>$', 1, 's') as inside from walk w join tk t using (src, page_id, i) where t.kind = 'open'),
    node as materialized (select * exclude (inside), list_transform(regexp_extract_all(inside, '([^\\s=/"''<>]+)(?:\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>]+))?', 1), lambda n: lower(n)) as names,
      list_transform(regexp_extract_all(inside, '([^\\s=/"''<>]+)(?:\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>]+))?', 2), lambda v: {decoded("case when v[1] in (chr(34), chr(39)) then v[2:len(v) - 1] else v end")}) as vals from heads),
    open_at as (select src, page_id, i, unnest(ids) as id from walk),
    closed as materialized (select src, page_id, id as i, max(i) as last from open_at group by all),
    anc as materialized (select src, page_id, i, i as a from node union all select n.src, n.page_id, n.i, p.id from node n join open_at p on p.src = n.src and p.page_id = n.page_id and p.i = n.i and p.id <> n.i),
    marks as materialized (select src, page_id, i, tag, regexp_matches({attribute('id')}, '^(navFooter|footer)$') or tag = 'footer' or regexp_matches({attribute('class')}, '(^|\\s)(footer|navFooterLine)(\\s|$)') or {attribute('role')} = 'contentinfo' as footer,
      list_contains(names, 'hidden') or regexp_matches(replace({attribute('style')}, ' ', ''), '(?i)display:none|visibility:hidden') or (tag = 'input' and lower({attribute('type')}) = 'hidden') as unshown,
      tag = 'dialog' or regexp_matches({attribute('class')} || ' ' || {attribute('id')}, '(?i)otp|verification') or {attribute('role')} = 'dialog' or regexp_matches({attribute('class')}, '(^|\\s)modal(\\s|$)') as code from node),
    inside as materialized (select src, page_id, n.i, bool_or(m.footer) as footer, bool_or(m.unshown) as unshown, bool_or(m.code) as code from anc n join marks m using (src, page_id) where m.i = n.a group by all),
    quiet as (select distinct o.src, o.page_id, o.i from open_at o join marks m on m.src = o.src and m.page_id = o.page_id and m.i = o.id where m.footer or m.unshown or m.tag in ('script', 'style', 'title', 'noscript', 'textarea')),
    said as materialized (select t.src, t.page_id, t.i, case when t.kind = 'text' then {decoded('t.x')} else chr(10) end as x from tk t left join quiet q using (src, page_id, i)
      where q.i is null and (t.kind = 'text' or (t.kind in ('open', 'end') and contains({_NAMES([*sorted(tree.BLOCKS), 'br'])}, '|' || t.tag || '|'))))"""


def plain(x: str) -> str:
    return duck.trim(f"regexp_replace({x}, '\\s+', ' ', 'g')")


_A = attribute
_SENSITIVE = " or ".join([f"regexp_matches({c}, '(?i){pages.SENSITIVE_NAME}')" for c in ("name", "id", "placeholder", "aria")] + [f"regexp_matches(case when value <> '' then value else text end, {duck.q(p)})" for p in pages.SENSITIVE_VALUES])
#: ``el``: the interactive elements that count, numbered, at most MOST of a page.
ELEMENT_CTES = f"""{TREE_CTES},
    cand as (select n.*, s.footer, s.code, case when tag in ('button', 'input', 'textarea', 'select') or (tag = 'a' and list_contains(names, 'href')) or {_A('role')} in ('button', 'link', 'checkbox', 'tab', 'menuitem', 'searchbox', 'combobox', 'switch', 'option')
        or list_contains(names, 'onclick') or list_contains(names, 'data-action') or (list_contains(names, 'tabindex') and {_A('tabindex')} <> '-1') then 1
        when tag in ('div', 'span', 'li', 'summary', 'label') and regexp_matches({_A('style')}, '(?i)cursor: ?pointer') then 2 else 0 end as kind from node n join inside s using (src, page_id, i) where not s.unshown),
    kids as (select src, page_id, parent as i, count(*) as children from node group by all),
    usable as (select c.*, coalesce(children, 0) as children from cand c left join kids using (src, page_id, i) where kind > 0 and not footer),
    pictures as (select u.src, u.page_id, u.i, arg_min({_A('alt', 'n.names, n.vals')}, n.i) filter (n.tag = 'img') as image, arg_min({_A('aria-label', 'n.names, n.vals')}, n.i) filter (n.tag = 'svg') as drawing
      from usable u join anc using (src, page_id) join node n on n.src = u.src and n.page_id = u.page_id and n.i = anc.i where anc.a = u.i and anc.i <> u.i and n.tag in ('img', 'svg') group by all),
    told as (select u.src, u.page_id, u.i, string_agg(x.x, '' order by x.i) as inner_text from usable u join closed c using (src, page_id, i) join said x on x.src = u.src and x.page_id = u.page_id and x.i > u.i and x.i <= c.last group by all),
    areas_text as (select u.src, u.page_id, u.i, string_agg(t.x, '' order by t.i) as content from usable u join closed c using (src, page_id, i) join tk t on t.src = u.src and t.page_id = u.page_id and t.i > u.i and t.i <= c.last where u.tag = 'textarea' and t.kind = 'text' group by all),
    opt as materialized (select u.src, u.page_id, u.i, n.i as oi, {plain("string_agg(case when x.i > n.i and x.i <= oc.last then x.x else '' end, '' order by x.i)")} as label, any_value(case when list_contains(n.names, 'value') then {_A('value', 'n.names, n.vals')} end) as given, any_value(list_contains(n.names, 'selected')) as selected
      from usable u join anc using (src, page_id) join node n on n.src = u.src and n.page_id = u.page_id and n.i = anc.i join closed oc on oc.src = n.src and oc.page_id = n.page_id and oc.i = n.i join closed c on c.src = u.src and c.page_id = u.page_id and c.i = u.i join said x on x.src = u.src and x.page_id = u.page_id and x.i > u.i and x.i <= c.last
      where anc.a = u.i and u.tag = 'select' and n.tag = 'option' group by all),
    option_of as (select src, page_id, i, oi, label, coalesce(given, label) as value, selected, row_number() over (partition by src, page_id, i order by oi) - 1 as o from opt),
    picked as (select src, page_id, i, arg_min(value, case when selected then oi - 1000000 else oi end) as picked from option_of group by all),
    parts as (select u.src, u.page_id, u.i, u.kind, u.children, u.code, u.tag, u.names, u.vals, u.parent, {', '.join(f'{_A(a)} as {n}' for n, a in (('name', 'name'), ('id', 'id'), ('placeholder', 'placeholder'), ('role', 'role'), ('href', 'href'), ('label', 'aria-label'), ('title', 'title'), ('cls', 'class'), ('mx', 'maxlength'), ('wd', 'size')))}, lower({_A('type')}) as type,
      case when u.tag = 'textarea' then {decoded("coalesce(content, '')")} when u.tag = 'select' then coalesce(picked, '') when u.tag = 'input' and lower({_A('type')}) in ('checkbox', 'radio') and not list_contains(names, 'value') then 'on' when u.tag in ('input', 'button') then {_A('value')} else '' end as value,
      {plain("coalesce(inner_text, '')")} as inner_text, image, drawing from usable u left join told using (src, page_id, i) left join pictures using (src, page_id, i) left join areas_text using (src, page_id, i) left join picked using (src, page_id, i)),
    steps as (select src, page_id, i as a, tag, tag || case when regexp_matches({_A('class')}, '^\\s*[^\\s:/]+(\\s|$)') then '.' || regexp_extract({_A('class')}, '^\\s*([^\\s:/]+)', 1) else '' end
      || case when count(*) over (partition by src, page_id, parent, tag) > 1 then ':nth-of-type(' || row_number() over (partition by src, page_id, parent, tag order by i) || ')' else '' end as step from node),
    paths as (select u.src, u.page_id, u.i, string_agg(s.step, ' > ' order by s.a) as path from usable u join anc on anc.src = u.src and anc.page_id = u.page_id and anc.i = u.i join steps s on s.src = u.src and s.page_id = u.page_id and s.a = anc.a where s.tag not in ('body', 'html') group by all),
    named as (select *, case when label <> '' then label else title end as aria, tag = 'input' and (mx = '1' or wd = '1') and code as is_cell,
      case when tag in ('input', 'textarea') and value <> '' and type <> 'password' then value when tag <> 'textarea' and inner_text <> '' then inner_text when coalesce(drawing, '') <> '' then drawing else coalesce(image, '') end as text,
      row_number() over (partition by src, page_id, kind order by i) as rank, count(*) filter (kind = 1) over (partition by src, page_id) as ones from parts),
    el_all as (select n.*, cast(row_number() over (partition by src, page_id order by kind, i) - 1 as int) as idx, is_cell or type in ('password', 'email', 'tel') or ({_SENSITIVE}) as is_sensitive,
      case when id <> '' then '#' || id when name <> '' then tag || '[name="' || name || '"]' when label <> '' then tag || '[aria-label="' || replace(label, ' ', '\\ ') || '"]' when role <> '' then tag || '[role="' || role || '"]' else path end as selector
      from named n join paths using (src, page_id, i) where kind = 1 or children = 0 or (children = 1 and (image is not null or drawing is not null))),
    el as (select * from el_all where idx < 60)"""
