"""Detection: a text column to an array of findings, in the order of rules and matches.

Everything is one projection of built-in functions over the row, so a scan of documents
stays a single stage without a shuffle, and texts never leave their row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import checks, js
from cloakwork.operators import resolve
from cloakwork.operators.rules import CONTEXTUAL_RULES, NOT_ADDRESS, NOT_PIN, RULES, SENSITIVE_MARKERS, Rule

FINDING = "struct<category:string,value:string,risk:string,source:string,confidence:double>"


def valid(rule: Rule, v: Column) -> Column:
    """The rule's check of a trimmed value."""
    lower = F.lower(v)
    if rule.check == "email":
        user, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
        return (F.size(F.split(v, "@")) == 2) & user.rlike("[A-Za-z0-9]") & domain.contains(".") & (F.length(domain) >= 4)
    if rule.check == "phone_in":
        kept = F.regexp_replace(v, F.lit("[^0-9*•x]"), F.lit(""))
        return (F.length(kept) == 10) | ((F.length(kept) == 12) & kept.startswith("91"))
    if rule.check == "verhoeff":
        return checks.verhoeff(v)
    if rule.check == "card":
        number = js.digits(v)
        return F.length(number).between(13, 19) & checks.luhn(number)
    if rule.check == "address":
        return ~js.matches(lower, NOT_ADDRESS, True) & ~checks.brand(v)
    if rule.check == "address_pin":
        return ~js.matches(lower, NOT_PIN, True) & ~checks.brand(v)
    if rule.check == "passport":
        return js.replace(v, r"\s").rlike("^[A-Za-z][0-9]{7}$")
    return F.lit(True)


#: All rules' guards in one; what it doesn't match has no finding.
ANY_GUARD = "[0-9@]|(?i:address)|sk-|ghp_|AIza|eyJ"


#: The guard of rules without one of their own.
DIGIT_GUARD = Rule.guard


def spared(rule: Rule, text: Column, found: Column, low: Column | None = None, guarded: bool = False) -> Column:
    """The rule's values where its guard and words let it match, else none. ``low`` is the text in small letters, which all rules of a row
    share; ``guarded`` says that the text has met DIGIT_GUARD already."""
    tests = [] if guarded and rule.guard == DIGIT_GUARD else [text.rlike(rule.guard)]
    if rule.words:
        low = F.lower(text) if low is None else low
        tests.append(reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in rule.words]))
    return F.when(reduce(Column.__and__, tests), found).otherwise(F.array().cast("array<string>")) if tests else found


def matches(rule: Rule, text: Column, low: Column | None = None) -> Column:
    """The rule's valid values, in the order of the text; repeats included."""
    found = F.transform(js.extract_all(text, rule.pattern.replace(r"(?<!\d[-\s]?)", r"(?<!\d)(?<!\d[-\s])"), rule.group, rule.ignore_case), js.trim)
    found = F.filter(found, lambda v: (F.length(v) >= 2) & valid(rule, v))
    return spared(rule, text, found, low)


def finding(rule: Rule, source: str):
    """Makes a finding of a value."""
    return lambda v: F.struct(F.lit(rule.category).alias("category"), v.alias("value"), F.lit(rule.risk).alias("risk"), F.lit(source).alias("source"), F.lit(rule.confidence).alias("confidence"))


def rulebook(text: Column) -> Column:
    """Findings of the rulebook, repeats included."""
    found = lambda low: F.flatten(F.array(*(F.transform(matches(rule, text, low), finding(rule, "RULEBOOK")) for rule in RULES))).cast(f"array<{FINDING}>")
    return js.once(F.lower(text), found)


def contextual_matches(rule: Rule, text: Column, low: Column | None = None) -> Column:
    found = F.transform(js.extract_all(text, rule.pattern, 1, True), lambda v: F.regexp_replace(js.trim(v), F.lit(f"^[:#\\-—{js.SPACES}]+|[:#\\-—{js.SPACES}]+$"), F.lit("")))
    keep = lambda v: (F.length(v) >= 3) & ~checks.stop_word(v) & (v.rlike("[0-9]") if rule.needs_digit else F.lit(True))
    return spared(rule, text, F.filter(found, keep), low, low is not None)


def contextual(text: Column) -> Column:
    """Candidates of the contextual rules; confidence is the rule's base as yet."""
    found = lambda low: F.flatten(F.array(*(F.transform(contextual_matches(rule, text, low), finding(rule, "ML_EDGE_MODEL")) for rule in CONTEXTUAL_RULES))).cast(f"array<{FINDING}>")
    # What the guard of most rules asks, all texts with a finding have.
    return F.when(text.rlike(DIGIT_GUARD), js.once(F.lower(text), found)).otherwise(F.array().cast(f"array<{FINDING}>"))


def first_of(found: Column, key) -> Column:
    """Of findings with one key the first; the findings and each one's key are computed once."""
    pairs = F.transform(found, lambda f: F.struct(f.alias("f"), key(f).alias("k")))
    kept = F.aggregate(
        pairs,
        F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(f"array<{FINDING}>").alias("out")),
        lambda a, p: F.when(F.array_contains(a["seen"], p["k"]), a).otherwise(F.struct(F.array_append(a["seen"], p["k"]).alias("seen"), F.array_append(a["out"], p["f"]).alias("out"))),
    )
    return kept["out"]


def with_confidence(found: Column) -> Column:
    """The n-th contextual finding's confidence: base + (n mod 5) / 100, at most 0.99."""
    return F.transform(found, lambda f, i: F.struct(f["category"].alias("category"), f["value"].alias("value"), f["risk"].alias("risk"), f["source"].alias("source"), F.least(F.lit(0.99), F.round(f["confidence"] + ((i + 1) % 5) * 0.01, 2)).alias("confidence")))


def sensitivity(text: Column, found: Column) -> Column:
    """The contextual sensitivity index, 0 to 100; 0 for a blank text."""
    count = lambda risk: F.size(F.filter(found, lambda f: f["risk"] == risk))
    base = F.least(F.lit(100), count("HIGH") * 30 + count("MEDIUM") * 15 + F.size(found) * 8)
    marked = F.when(js.matches(text, SENSITIVE_MARKERS, True), F.greatest(base, F.lit(85))).otherwise(base)
    return F.when(js.trim(text) == "", F.lit(0)).otherwise(marked).cast("int")


def with_findings(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``findings``: the rulebook's, one for each canonical key, then the contextual
    ones of new keys; and ``sensitivity``. A null text is an empty one."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(f"array<{FINDING}>")
    may = t.rlike(ANY_GUARD)
    context = with_confidence(first_of(contextual(t), lambda f: F.lower(f["value"])))
    rows = rows.withColumns({"__rules": F.when(may, rulebook(t)).otherwise(none), "__context": F.when(may, context).otherwise(none)})
    key = lambda f: resolve.canonical_key(f["category"], f["value"])
    both = F.concat("__rules", "__context")
    return rows.withColumns({"sensitivity": sensitivity(t, F.col("__context")), "findings": F.when(F.size(both) > 0, first_of(both, key)).otherwise(none)}).drop("__rules", "__context")
