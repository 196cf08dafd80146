"""Acting: offline plans, action safety, field categories and autofill."""

from __future__ import annotations

from cloakwork.functions.dialect import Spark, trim

# Patterns and defaults that results depend on.
CRITICAL = (r"\bpay\b", "payment", "purchase", r"buy\s*now", r"\bbuy\b", "checkout", r"proceed\s+to\s+buy", r"proceed\s+to\s+checkout", r"place\s*order", r"complete\s*order", r"delete\s*account", r"\bdelete\b", r"\btransfer\b", r"send\s*money", r"confirm\s*payment", "subscribe")
SAFE_ACTIONS = ("finish", "wait", "scroll")
PLAN_NAVIGATE = r"\b(?:open|go\s+to|navigate(?:\s+to)?|visit|browse(?:\s+to)?)\s+['\"]?([^'\"]+?)['\"]?$"
NOT_PLACES = r"\b(?:cart|carts|order|orders|here|there)\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONES = (r"(?:\+91[-.\s]?)?[6-9]\d{4}[-.\s]?\d{5}", r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}")
PLACES = ("address", "street", "pincode", "postal", "city", "state", "zip", "district")
#: Field patterns of the vault, first match wins: (pattern, type, field, not).
VAULT = (
    ("aadhaar|aadhar|uidai", "", "aadhaar", ""), (r"\bpan\b|pancard", "", "pan", ""), ("passport", "", "passport", ""), (r"dl\b|driving.*licen", "", "licence", ""), (r"gender|sex\b", "", "gender", ""),
    (r"dob|birth|bday|date[_\s-]?of[_\s-]?birth", "date", "dob", ""), (r"alt.*phone|emergency.*phone|secondary.*phone|alt.*mobile", "", "alternate_phone", ""), ("email|e-mail", "email", "email", ""), ("phone|mobile|tel|contact", "tel", "phone", ""),
    (r"first[_\s-]?name|fname", "", "first_name", ""), (r"last[_\s-]?name|lname", "", "last_name", ""), (r"full[_\s-]?name|name|customer|recipient", "", "full_name", "user|login|pass"), ("pincode|postal|zip", "", "pincode", ""),
    (r"address|street|flat|house|building|suite|line[_\s-]?1|addr[_\s-]?1|addr\b", "", "address", "landmark"), ("landmark|locality", "", "landmark", ""), ("city|town|district", "", "city", ""), ("state|province|region", "", "state", ""), ("country|nation", "", "country", ""),
    (r"company|organization|org\b|business.*name|employer", "", "company", ""), (r"job.*title|role|designation|occupation", "", "job_title", ""), ("website|portfolio|url", "", "website", ""), (r"notes|comments?|message|description|feedback|inquiry", "", "notes", ""),
)


def any_of(x: str, ws) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in ws) + ")"


def search_field(c: str, type_: str, name: str, role: str) -> str:
    return f"({type_} = 'search' or {name} = 'q' or {role} in ('searchbox', 'search') or {any_of(c, ('search', 'query'))})"


def element_category(d: Spark, c: str, tag: str, type_: str, name: str, role: str, value: str, labels: str) -> str:
    """The category of an interactive element; the first test that holds decides."""
    entry = f"{tag} in ('input', 'textarea')"
    tests = (
        ("PASSWORD", f"{type_} = 'password' or {any_of(c, ('password', 'passwd'))}"),
        ("CVV", any_of(c, ("cvv", "cvc", "security code"))),
        ("CARD_EXPIRY", any_of(c, ("expir", "valid thru", "mm/yy"))),
        ("OTP", f"{entry} and {any_of(c, ('otp', 'one-time-code', 'verification-code', 'auth code'))}"),
        ("CARD", any_of(c, ("card",))),
        ("ADDRESS", f"not {search_field(c, type_, name, role)} and {any_of(c, PLACES)}"),
        ("AADHAAR", any_of(c, ("aadhaar", "aadhar", "uidai"))),
        ("PAN", f"{entry} and {d.match(labels, r'\b(?:pan|pancard|pan-card|pan_card|pan-number|pan_number)\b')}"),
        ("EMAIL", f"{type_} = 'email' or {any_of(c, ('mail',))} or {d.match(value, EMAIL)}"),
        ("PHONE", f"{type_} = 'tel' or {any_of(c, ('phone', 'mobile', 'cell', 'contact'))} or {d.match(value, PHONES[0])} or {d.match(value, PHONES[1])}"),
    )
    return "case " + " ".join(f"when {t} then '{n}'" for n, t in tests) + " end"


def dom_category(d: Spark, c: str, type_: str, name: str, role: str, value: str) -> str:
    """The category of a filled input in the page; another order than an element's."""
    filled = lambda n: f"length({value}) >= {n}"
    place = f"({any_of(c, PLACES)} or {d.match(c, r'\b(?:pin|postcode|zipcode)\b')} or ({d.match(value, r'^\d{6}$')} and {d.match(c, r'\b(?:pin|postal|zip|delivery|shipping|location)\b')}))"
    password = f"{type_} = 'password' or {any_of(c, ('password', 'passwd'))}"
    tests = (
        ("EMAIL", f"{type_} = 'email' or {any_of(c, ('mail',))} or {d.match(value, EMAIL)}"),
        ("PHONE", f"{type_} = 'tel' or {any_of(c, ('phone', 'mobile', 'cell', 'contact'))} or {d.match(value, PHONES[0])} or {d.match(value, PHONES[1])}"),
        ("AADHAAR", f"{any_of(c, ('aadhaar', 'aadhar', 'uidai'))} and {filled(4)}"),
        ("PAN", f"contains({c}, 'pan') and not contains({c}, 'panel') and {filled(4)}"),
        ("ADDRESS", f"not {search_field(c, type_, name, role)} and {place}"),
        ("PASSWORD", password),
        ("UPI", f"{any_of(c, ('upi', 'vpa'))} and {filled(4)}"),
        ("PASSPORT", f"contains({c}, 'passport') and {filled(6)}"),
        ("BANK_ACCOUNT", f"{any_of(c, ('ifsc', 'bank_acc', 'account_no'))} and {filled(4)}"),
    )
    cases = " ".join(f"when {t} then '{n}'" for n, t in tests)
    return f"case when {d.match(type_, '^(submit|button|checkbox|radio|reset|image)$')} then null when length({value}) < 2 then case when {password} then 'PASSWORD' end {cases} end"


def vault_field(d: Spark, descriptor: str, type_: str) -> str:
    """The vault's field for an input; null for radios, checkboxes and unknown ones."""
    tests = []
    for p, t, field, barred in VAULT:
        test = d.match(descriptor, p) + (f" or {type_} = '{t}'" if t else "")
        tests.append(f"when ({test})" + (f" and not {d.match(descriptor, barred)}" if barred else "") + f" then '{field}'")
    return f"case when {type_} in ('radio', 'checkbox') then null {' '.join(tests)} end"


def custom_pair(d: Spark, pairs: str, descriptor: str) -> str:
    """The first of a prompt's pairs ('key=value') whose key, without marks, is in a field's descriptor; null if none is."""
    bare = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', ''{'' if type(d) is Spark else ', ' + chr(39) + 'g' + chr(39)})"
    key = bare("split_part(p, '=', 1)")
    return d.at(d.filter(pairs, "p", f"length({key}) >= 2 and contains({bare(descriptor)}, {key})"), 0)


def audit_value(x: str) -> str:
    """What an audit shows of a filled value."""
    return f"concat(substr({x}, 1, 4), '••••')"


def critical(d: Spark, x: str) -> str:
    return "(" + " or ".join(d.match(x, p) for p in CRITICAL) + ")"


def plan_target(d: Spark, goal: str) -> str:
    """Where an offline plan navigates; empty if it doesn't."""
    t = trim(d, d.extract(goal, PLAN_NAVIGATE))
    return f"case when {d.match(t, NOT_PLACES)} then '' else {t} end"
