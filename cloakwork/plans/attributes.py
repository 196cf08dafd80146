"""The query over elements that name what they hold, and its SQL, written apart from the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakwork.functions import checks
from cloakwork.operators import attributes as at
from cloakwork.plans import duck, trees
from cloakwork.sources import forms, profiles


def page_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at.attribute_findings(profiles.pages(spark, sf_dir), "page_id")


_NAMED = lambda i, c=None: f"(regexp_matches(id, '(?i){i}') or regexp_matches(cls, '(?i){c or i}'))"
_BARE = "tag not in ('input', 'textarea')"
_DIGITS = "regexp_replace(text, '[^0-9]', '', 'g')"
_SHOP = "regexp_matches(id || ' ' || cls, '(?i)\\b(?:ingress|delivery-location|location-slot)\\b')"
#: Category, value, mask, risk and condition of each.
_RULES = (
    ("EMAIL", "text", "[REDACTED_EMAIL]", "MEDIUM", f"{_BARE} and {_NAMED('email')} and regexp_matches(text, {duck.q(at.EMAIL_FORM)})"),
    ("PHONE", "text", "[REDACTED_PHONE]", "MEDIUM", f"{_BARE} and {_NAMED('phone|mobile')} and regexp_matches(text, {duck.q(at.PHONE_FORM)})"),
    ("CVV", "text", "███", "HIGH", f"{_NAMED('cv[vc]')} and regexp_full_match(text, '[0-9]{{3,4}}')"),
    ("CARD_EXPIRY", "text", "[CARD_EXPIRY]", "HIGH", f"({_NAMED('exp')} or cards) and regexp_full_match(text, '(0[1-9]|1[0-2])[/-](20)?[0-9][0-9]')"),
    ("OTP", "text", "██████", "HIGH", f"{_NAMED('val-otp|otp-code', 'otp-val|otp-code')} and regexp_full_match(text, '[0-9]{{4,8}}')"),
    ("UPI", "text", "[REDACTED_UPI]", "HIGH", f"{_BARE} and {_NAMED('upi|vpa', 'upi')} and regexp_matches(text, '[a-zA-Z0-9._-]{{2,64}}@[a-zA-Z]{{2}}')"),
    ("BANK_ACCOUNT", "text", "[REDACTED_IFSC]", "MEDIUM", f"{_BARE} and {_NAMED('ifsc|bank-ac|account-num', 'ifsc|bank-ac')} and regexp_matches(text, '\\b[A-Z]{{4}}0[A-Z0-9]{{6}}\\b')"),
    ("BANK_ACCOUNT", "text", "[REDACTED_BANK_AC]", "HIGH", f"{_BARE} and {_NAMED('ifsc|bank-ac|account-num', 'ifsc|bank-ac')} and regexp_matches(text, '\\b[0-9]{{9,18}}\\b') and not regexp_matches(text, '\\b[A-Z]{{4}}0[A-Z0-9]{{6}}\\b')"),
    ("PASSPORT", "text", "[REDACTED_PASSPORT]", "HIGH", f"{_BARE} and {_NAMED('passport')} and regexp_full_match(text, '(?i)[a-pr-wy][1-9][0-9]\\s?[0-9]{{4}}[1-9]')"),
    ("CARD", "text", "[REDACTED_CARD]", "HIGH", f"{_BARE} and children <= 1 and {_NAMED('card[-_]num', 'card-num|cc[-_]num')} and length({_DIGITS}) between 13 and 19 and {duck.luhn('text')}"),
    ("AADHAAR", "text", "[REDACTED_AADHAAR]", "HIGH", f"{_BARE} and children <= 1 and {_NAMED('aadhaa?r|uidai')} and length({_DIGITS}) = 12 and {duck.verhoeff('text')}"),
    ("PAN", "text", "[REDACTED_PAN]", "HIGH", f"{_BARE} and children <= 1 and {_NAMED('pan')} and regexp_full_match(regexp_replace(text, '\\s', '', 'g'), '[A-Z]{{5}}[0-9]{{4}}[A-Z]')"),
    ("PASSWORD", "text", "████████", "HIGH", f"{_BARE} and {_NAMED('val-pass|password', 'password')} and (contains(text, '••••') or (length(text) >= 4 and translate(text, '•*●x█', '') = ''))"),
    ("ADDRESS", "place", "[REDACTED_LOCATION]", "MEDIUM", f"{_BARE} and not search and (children <= 2 or {_SHOP}) and (lower(id) in ('glow-ingress-line1', 'glow-ingress-line2') or {_NAMED('location-slot|address|city|pincode|postal|zip', 'delivery-location|address|city|pincode|postal|zip')}) and ({_SHOP} or regexp_matches(id || ' ' || cls, {duck.q('(?i)' + at.PLACE_NAME)})) and length(place) between 3 and 150 and not regexp_matches(place, {duck.q('(?i)' + at.NO_PLACE)}) and (not {_SHOP} or regexp_matches(place, {duck.q(at.PLACE_DIGITS)}) or regexp_matches(place, {duck.q('(?i)' + at.PLACE_WORDS)}) or regexp_matches(place, {duck.q(at.PLACE_CAPITAL)}))"),
    ("FINANCIAL", "text", at.PAY_MASK, "HIGH", f"(contains(style, 'border-left') or dossiers) and children <= 1 and regexp_matches(text, '[0-9]') and regexp_matches(text, {duck.q('(?i)' + at.PAY)})"),
    ("LEGAL", "text", at.LAW_MASK, "HIGH", f"(contains(style, 'border-left') or dossiers) and children <= 1 and regexp_matches(text, '[0-9]') and regexp_matches(text, {duck.q('(?i)' + at.LAW)}) and not regexp_matches(text, {duck.q('(?i)' + at.PAY)})"),
)
_TREE = trees.TREE_CTES.replace(forms.ALL_SQL, f"select 'profiles' as src, page_id, html from ({profiles.pages_sql()}) q")
_A = trees.attribute
DETECTORS_SQL = f"""with recursive {_TREE},
    titled as (select a.src, a.page_id, a.i, bool_or(n.tag in ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') or {_A('role', 'n.names, n.vals')} = 'heading' or regexp_matches({_A('class', 'n.names, n.vals')}, '(^|\\s)(badge|card-header)(\\s|$)')) as titled,
      bool_or({_A('role', 'n.names, n.vals')} in ('search', 'searchbox')) as search, bool_or(a.a <> a.i and regexp_matches({_A('class', 'n.names, n.vals')}, '(^|\\s)(credit-card|payment-cards)(\\s|$)')) as cards, bool_or(a.a <> a.i and regexp_matches({_A('class', 'n.names, n.vals')}, '(?i)dossier|unstructured')) as dossiers
      from anc a join node n on n.src = a.src and n.page_id = a.page_id and n.i = a.a group by all),
    told as (select n.src, n.page_id, n.i, string_agg(x.x, '' order by x.i) as t from node n join closed c using (src, page_id, i) join said x on x.src = n.src and x.page_id = n.page_id and x.i > n.i and x.i <= c.last group by all),
    kids as (select src, page_id, parent as i, count(*) as children from node group by all),
    named as (select n.page_id, cast(row_number() over (partition by n.page_id order by n.i) - 1 as int) as pos, n.tag, {_A('id')} as id, {_A('class')} as cls, {_A('style')} as style, search, cards, dossiers, coalesce(children, 0) as children, s.footer or s.unshown or titled as barred,
      {duck.trim("case when n.tag = 'input' then " + _A('value') + " else coalesce(t, '') end")} as text from node n join titled using (src, page_id, i) join inside s using (src, page_id, i) left join told using (src, page_id, i) left join kids using (src, page_id, i)),
    el as (select *, {duck.trim(f"regexp_replace(text, {duck.q('(?i)' + at.PLACE_TAIL)}, '', 'g')")} as place from named where not barred and text <> '' and tag not in {duck.words(at.HEADINGS)} and lower(text) not in {duck.words(checks.BRAND_WORDS)})
    {' union all '.join(f"select page_id, pos, {duck.q(c)} as category, {v} as value, {duck.q(m)} as masked, {duck.q(r)} as risk from el where length({v}) >= {1 if c in ('OTP', 'CVV') else 2} and {w}" for c, v, m, r, w in _RULES)}"""

QUERIES = {"page_detectors": page_detectors}
SQL = {"page_detectors": DETECTORS_SQL}
