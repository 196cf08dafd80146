"""Pieces of DuckDB SQL for the comparison queries; a second writing of the operators."""

from __future__ import annotations

from cloakwork.functions.checks import BRAND_WORDS, STOP_WORDS, VERHOEFF_D, VERHOEFF_P
from cloakwork.operators.resolve import ACTION_PHRASE, ACTION_PHRASES, CODE_HEADING, DELIVERY_PREFIX, LOCATION_SUFFIX, LOCATION_TAIL, MASKS
from cloakwork.operators.rules import NOT_ADDRESS, NOT_PIN, Rule


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(ws) -> str:
    return "(" + ", ".join(map(q, ws)) + ")"


def like(v: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({v}, {q(('(?i)' if ignore_case else '') + pattern)})"


def sub(v: str, pattern: str, by: str = "", flags: str = "g") -> str:
    return f"regexp_replace({v}, {q(pattern)}, {q(by)}, {q(flags)})"


def trim(v: str) -> str:
    return sub(v, r"^\s+|\s+$")


def digits(v: str) -> str:
    return sub(v, "[^0-9]")


def luhn(v: str) -> str:
    n = digits(v)
    d = f"cast(substr(reverse({n}), cast(i as int), 1) as int)"
    return f"list_sum(list_transform(generate_series(1, length({n})), lambda i: case when i % 2 = 1 then {d} when {d} > 4 then 2 * {d} - 9 else 2 * {d} end)) % 10 = 0"


def verhoeff(v: str) -> str:
    n = digits(v)
    step = f"cast(substr('{''.join(VERHOEFF_P)}', cast(i % 8 * 10 + cast(substr(reverse({n}), cast(i + 1 as int), 1) as int) + 1 as int), 1) as int)"
    fold = f"list_reduce(list_prepend(0, list_transform(generate_series(0, length({n}) - 1), lambda i: {step})), lambda c, x: cast(substr('{''.join(VERHOEFF_D)}', c * 10 + x + 1, 1) as int))"
    return f"({like(n, '^[2-9][0-9]{11}$')} and replace({n}, substr({n}, 1, 1), '') <> '' and {fold} = 0)"


def valid(rule: Rule, v: str) -> str:
    low = f"lower({v})"
    if rule.check == "email":
        dom = f"split_part({v}, '@', 2)"
        return f"length({v}) - length(replace({v}, '@', '')) = 1 and {like(f'split_part({v}, chr(64), 1)', '[A-Za-z0-9]')} and contains({dom}, '.') and length({dom}) >= 4"
    if rule.check == "phone_in":
        k = sub(v, "[^0-9*•x]")
        return f"(length({k}) = 10 or (length({k}) = 12 and starts_with({k}, '91')))"
    if rule.check == "verhoeff":
        return verhoeff(v)
    if rule.check == "card":
        return f"length({digits(v)}) between 13 and 19 and {luhn(v)}"
    if rule.check in ("address", "address_pin"):
        return f"not {like(low, NOT_ADDRESS if rule.check == 'address' else NOT_PIN, True)} and {trim(low)} not in {words(BRAND_WORDS)}"
    if rule.check == "passport":
        return like(sub(v, r"\s"), "^[A-Za-z][0-9]{7}$")
    return "true"


def found(rule: Rule, text: str) -> str:
    """The list of a rule's valid values."""
    if rule.check == "verhoeff":
        # No look-around here: whole runs of digit groups between other characters are taken
        # and kept if they have the format.
        p = r"[A-Za-z_]?\d(?:[-\s]?\d)*[A-Za-z_]?"
        raw = f"list_filter(regexp_extract_all({text}, {q(p)}), lambda v: {like('v', r'^[2-9]\d{3}[-\s]?\d{4}[-\s]?\d{4}$')})"
    else:
        raw = f"regexp_extract_all({text}, {q(('(?i)' if rule.ignore_case else '') + rule.pattern)}, {rule.group})"
    return f"list_filter(list_transform({raw}, lambda v: {trim('v')}), lambda v: length(v) >= 2 and {valid(rule, 'v')})"


def context(rule: Rule, text: str) -> str:
    cut = r"^[:#\-—\s]+|[:#\-—\s]+$"
    raw = f"list_transform(regexp_extract_all({text}, {q('(?i)' + rule.pattern)}, 1), lambda v: {sub(trim('v'), cut)})"
    need = like("v", "[0-9]") if rule.needs_digit else "true"
    return f"list_filter({raw}, lambda v: length(v) >= 3 and lower(v) not in {words(STOP_WORDS)} and {need})"


def findings(rules, text: str, source: str) -> str:
    """One list of structs of all rules, in order."""
    parts = []
    for r in rules:
        values = context(r, text) if source != "RULEBOOK" else found(r, text)
        parts.append(f"list_transform({values}, lambda v: {{'category': {q(r.category)}, 'value': v, 'risk': {q(r.risk)}, 'source': {q(source)}, 'confidence': {r.confidence}::double}})")
    return "flatten([" + ", ".join(parts) + "])"


def key(category: str, value: str) -> str:
    """The canonical key."""
    v = trim(value)
    low, up, n = f"lower({v})", f"upper({v})", digits(v)
    core = f"case when length({n}) = 12 and starts_with({n}, '91') then substr({n}, 3) when length({n}) = 11 and substr({n}, 1, 1) in ('0', '1') then substr({n}, 2) else {n} end"
    place = trim(sub(sub(low, DELIVERY_PREFIX, "", ""), LOCATION_TAIL, "", ""))
    pin = f"regexp_extract({place}, {q(r'\b([1-9][0-9]{5})\b')}, 1)"
    letters = f"substr({sub(place, '[^a-z]')}, 1, 15)"
    return f"""case when coalesce({value}, '') = '' then {category} || '_empty' else case {category}
      when 'EMAIL' then 'email_' || {low}
      when 'PHONE' then 'phone_' || case when length({core}) >= 10 then right({core}, 10) when ({core}) <> '' then {core} else {v} end
      when 'AADHAAR' then 'aadhaar_' || coalesce(nullif({n}, ''), {v})
      when 'PAN' then 'pan_' || {sub(up, '[^A-Z0-9]')}
      when 'CARD' then 'card_' || {n}
      when 'CARD_EXPIRY' then 'exp_' || lower({sub(v, r'[\s/-]')})
      when 'CVV' then 'cvv_' || {n}
      when 'OTP' then 'otp_' || {n}
      when 'ADDRESS' then case when {pin} <> '' then 'addr_in_' || coalesce(nullif({letters}, ''), 'pin') || '_' || {pin} else 'addr_' || substr({sub(place, '[^a-z0-9]')}, 1, 35) end
      when 'UPI' then 'upi_' || {low}
      when 'PASSPORT' then 'passport_' || {sub(up, r'\s+')}
      when 'BANK_ACCOUNT' then 'bank_' || upper({sub(v, '[^a-zA-Z0-9]')})
      when 'AVATAR' then 'avatar_' || {low} when 'FACE' then 'avatar_' || {low}
      else lower({category}) || '_' || {sub(low, r'\s+', ' ')} end end"""


def stripped(v: str) -> str:
    return trim(sub(v, "(?i)" + LOCATION_SUFFIX, "", ""))


def admissible(category: str, v: str) -> str:
    low = f"lower({trim(v)})"
    return f"""(length({trim(v)}) >= 2 and {low} not in {words(STOP_WORDS)} and not {like(low, ACTION_PHRASE)} and {low} not in {words(ACTION_PHRASES)}
      and not ({category} = 'ADDRESS' and ({like(low, CODE_HEADING)} or {low} in {words(BRAND_WORDS)}))
      and not ({category} = 'LEGAL' and not {like(v, '[0-9]')}))"""


def mask(category: str, n: str) -> str:
    cases = " ".join(f"when {q(c)} then {q(m)}" for c, m in MASKS.items())
    return f"case {category} {cases} else '[' || {category} || '_' || {n} || ']' end"
