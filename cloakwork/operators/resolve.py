"""Entity resolution: canonical keys, merging, containment, masks and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import checks, js

# Formats that results depend on.
LOCATION_SUFFIX = r"\s*(?:\r?\n)+\s*(?:update|change|select)\s+location\b[^\n\r]*$"
ACTION_PHRASE = r"^(?:update|change|select|choose|enter|set|add|manage|view|edit|see|your)\s+(?:location|address|pincode|zipcode|city|delivery|destination)$"
ACTION_PHRASES = ("update location", "change location", "select your address", "choose your location", "select location", "add address", "manage address", "your location", "your address")
CODE_HEADING = r"\b(?:two-factor|2fa|authenticat|active otp|login otp|verification|code is|login code|current login otp)\b"
MASKS = {"CVV": "███", "OTP": "██████", "CARD_EXPIRY": "[CARD_EXPIRY]", "ADDRESS": "[REDACTED_LOCATION]", "PASSWORD": "████████", "NAME": "[REDACTED_NAME]", "UPI": "[REDACTED_UPI]", "PASSPORT": "[REDACTED_PASSPORT]", "BANK_ACCOUNT": "[REDACTED_BANK_AC]", "AVATAR": "[BLURRED_AVATAR]", "FACE": "[BLURRED_AVATAR]"}
DELIVERY_PREFIX = r"^(?:delivering|deliver(?:y)?|ship(?:ping)?|send|order\s+to|destination)\s+(?:to|in|at)\s+"
LOCATION_TAIL = r"\b(?:update|change|select)\s+location\b[^\n\r]*$"


def canonical_key(category: Column, value: Column) -> Column:
    """The key under which forms of one value meet."""
    return js.once(js.trim(value), lambda v: _key(category, value, v))


def _key(category: Column, value: Column, v: Column) -> Column:
    lower, upper, number = F.lower(v), F.upper(v), js.digits(v)
    spaced = js.replace(lower, r"\s+", " ")
    core = F.when((F.length(number) == 12) & number.startswith("91"), F.substring(number, 3, 10))
    core = core.when((F.length(number) == 11) & number.rlike("^[01]"), F.substring(number, 2, 10)).otherwise(number)
    phone = F.when(F.length(core) >= 10, F.right(core, F.lit(10))).when(core != "", core).otherwise(v)
    place = js.trim(js.replace(js.replace(lower, DELIVERY_PREFIX), LOCATION_TAIL))
    key = F.when(F.coalesce(value, F.lit("")) == "", F.concat(category, F.lit("_empty")))
    for name, k in (
        ("EMAIL", F.concat(F.lit("email_"), lower)),
        ("PHONE", F.concat(F.lit("phone_"), phone)),
        ("AADHAAR", F.concat(F.lit("aadhaar_"), F.coalesce(js.some(number), v))),
        ("PAN", F.concat(F.lit("pan_"), F.regexp_replace(upper, F.lit("[^A-Z0-9]"), F.lit("")))),
        ("CARD", F.concat(F.lit("card_"), number)),
        ("CARD_EXPIRY", F.concat(F.lit("exp_"), F.lower(js.replace(v, r"[\s\/\-]")))),
        ("CVV", F.concat(F.lit("cvv_"), number)),
        ("OTP", F.concat(F.lit("otp_"), number)),
        ("ADDRESS", js.once(place, _address)),
        ("UPI", F.concat(F.lit("upi_"), lower)),
        ("PASSPORT", F.concat(F.lit("passport_"), js.replace(upper, r"\s+"))),
        ("BANK_ACCOUNT", F.concat(F.lit("bank_"), F.upper(F.regexp_replace(v, F.lit("[^a-zA-Z0-9]"), F.lit(""))))),
    ):
        key = key.when(category == name, k)
    key = key.when(category.isin("AVATAR", "FACE"), F.concat(F.lit("avatar_"), lower))
    return key.otherwise(F.concat(F.lower(category), F.lit("_"), spaced))


def _address(place: Column) -> Column:
    pin = js.extract(place, r"\b([1-9][0-9]{5})\b", 1)
    letters = F.substring(F.regexp_replace(place, F.lit("[^a-z]"), F.lit("")), 1, 15)
    address = F.when(pin != "", F.concat(F.lit("addr_in_"), F.coalesce(js.some(letters), F.lit("pin")), F.lit("_"), pin))
    return address.otherwise(F.concat(F.lit("addr_"), F.substring(F.regexp_replace(place, F.lit("[^a-z0-9]"), F.lit("")), 1, 35)))


def strip_suffix(value: Column) -> Column:
    return js.trim(js.replace(value, LOCATION_SUFFIX, ignore_case=True))


def admissible(category: Column, value: Column) -> Column:
    """Values that aren't page furniture; ``value`` is stripped already."""
    lower = F.lower(js.trim(value))
    phrase = js.matches(lower, ACTION_PHRASE, True) | checks.one_of(lower, ACTION_PHRASES)
    heading = (category == "ADDRESS") & (js.matches(lower, CODE_HEADING, True) | checks.one_of(lower, checks.BRAND_WORDS))
    return (F.length(js.trim(value)) >= 2) & ~checks.one_of(lower, checks.STOP_WORDS) & ~phrase & ~heading & ~((category == "LEGAL") & ~value.rlike("[0-9]"))


def mask(category: Column, n: Column) -> Column:
    """The final mask of a category's n-th entity."""
    out = F.when(F.lit(False), F.lit(""))
    for name, m in MASKS.items():
        out = out.when(category == name, F.lit(m))
    return out.otherwise(F.concat(F.lit("["), category, F.lit("_"), n.cast("string"), F.lit("]")))


def moved(a: Column, b: Column) -> Column:
    """Are two boxes more than 20 px apart."""
    return (F.abs(a["top"] - b["top"]) > 20) | (F.abs(a["left"] - b["left"]) > 20)


def overlap(a: Column, b: Column) -> Column:
    """The shared part of the smaller of two boxes; 0 for an empty one."""
    far = lambda box, at, size: box[at] + box[size]
    side = lambda at, size: F.greatest(F.lit(0), F.least(far(a, at, size), far(b, at, size)) - F.greatest(a[at], b[at]))
    area = F.least(a["width"] * a["height"], b["width"] * b["height"])
    return F.when(area > 0, side("left", "width") * side("top", "height") / area).otherwise(F.lit(0.0))


BOX = "struct<top:int,left:int,width:int,height:int>"
ENTITY = f"struct<category:string,value:string,risk:string,source:string,confidence:double,box:{BOX},element:int,selector:string,key:string>"


def merge(found: Column) -> Column:
    """Folds findings of one page, in order, by key. The first stays; it takes a box, an
    element and a higher confidence from later ones, and a longer formatted value. One
    seen more than 20 px away is an entity of its own under a key of its place; a later
    one at that very place takes its position."""

    def put(acc: Column, e: Column) -> Column:
        same = F.filter(acc, lambda x: x["key"] == e["key"])
        old = F.get(same, F.lit(0))
        apart = old["box"].isNotNull() & e["box"].isNotNull() & moved(old["box"], e["box"])
        richer = (F.length(e["value"]) > F.length(old["value"])) & e["value"].rlike(r"[+@ \-]")
        better = F.coalesce(e["confidence"], F.lit(0.0)) > F.coalesce(old["confidence"], F.lit(0.0))
        taken = lambda x: F.struct(
            x["category"].alias("category"),
            F.when(richer, e["value"]).otherwise(x["value"]).alias("value"),
            x["risk"].alias("risk"),
            x["source"].alias("source"),
            F.when(better, e["confidence"]).otherwise(x["confidence"]).alias("confidence"),
            F.coalesce(x["box"], e["box"]).alias("box"),
            F.coalesce(x["element"], e["element"]).alias("element"),
            F.when(x["element"].isNull() & e["element"].isNotNull(), e["selector"]).otherwise(x["selector"]).alias("selector"),
            x["key"].alias("key"),
        )
        merged = F.transform(acc, lambda x: F.when(x["key"] == e["key"], taken(x)).otherwise(x))
        place = F.concat(e["key"], F.lit("_loc_"), e["box"]["top"].cast("string"), F.lit("_"), e["box"]["left"].cast("string"))
        own = F.struct(*[(place if f == "key" else e[f]).alias(f) for f in ("category", "value", "risk", "source", "confidence", "box", "element", "selector", "key")])
        known = F.exists(merged, lambda x: x["key"] == place)
        placed = F.when(known, F.transform(merged, lambda x: F.when(x["key"] == place, own).otherwise(x))).otherwise(F.array_append(merged, own))
        return F.when(F.size(same) == 0, F.array_append(acc, e)).when(apart, placed).otherwise(merged)

    return F.aggregate(found, F.array().cast(f"array<{ENTITY}>"), put)


def give_boxes(entities: Column) -> Column:
    """Containment that removes an entity hands its box to the one that holds it."""
    low = lambda e: F.lower(js.trim(e["value"]))

    def heir(o: Column) -> Column:
        donors = F.filter(entities, lambda c: (c["category"] == o["category"]) & c["box"].isNotNull() & (F.length(low(c)) < F.length(low(o))) & F.contains(low(o), low(c)))
        return F.struct(*[(F.coalesce(o["box"], F.get(donors, F.lit(0))["box"]) if f == "box" else o[f]).alias(f) for f in ("category", "value", "risk", "source", "confidence", "box", "element", "selector", "key")])

    return F.transform(entities, heir)


def redundant(c: Column, i: Column, entities: Column) -> Column:
    """Is an entity held by another of its category: a longer value at no other place, or
    a box that overlaps by more than half with a value at least as long."""
    low = lambda e: F.lower(js.trim(e["value"]))

    def held(o: Column, j: Column) -> Column:
        boxed = c["box"].isNotNull() & o["box"].isNotNull()
        inside = (F.length(low(c)) < F.length(low(o))) & F.contains(low(o), low(c))
        apart = boxed & moved(c["box"], o["box"])
        over = boxed & (overlap(c["box"], o["box"]) > 0.5) & (F.length(low(c)) <= F.length(low(o)))
        return (i != j) & (c["category"] == o["category"]) & F.when(inside, ~apart).otherwise(over)

    return F.exists(F.transform(entities, held), lambda x: F.coalesce(x, F.lit(False)))


def with_entities(rows: DataFrame, findings: str = "findings", boxed: bool = False) -> DataFrame:
    """Adds ``entities``, array<struct<id, category, value, mask, risk, source, confidence,
    box, element, selector>>, resolved from the row's findings."""
    empty = {"box": BOX, "element": "int", "selector": "string"}
    field = lambda f, n: (f[n] if boxed else F.lit(None).cast(empty[n])).alias(n)
    stripped = F.transform(F.col(findings), lambda f: F.struct(f["category"].alias("category"), strip_suffix(f["value"]).alias("value"), f["risk"].alias("risk"), f["source"].alias("source"), f["confidence"].alias("confidence"), *(field(f, n) for n in empty)))
    kept = F.filter(stripped, lambda e: admissible(e["category"], e["value"]))
    keyed = F.transform(kept, lambda e: F.struct(*[e[n].alias(n) for n in ("category", "value", "risk", "source", "confidence", "box", "element", "selector")], canonical_key(e["category"], e["value"]).alias("key"))).cast(f"array<{ENTITY}>")
    rows = rows.withColumn("__given", merge(keyed))
    if boxed:
        rows = rows.withColumn("__given", give_boxes(F.col("__given")))
    rows = rows.withColumn("__e", F.filter("__given", lambda e, i: ~redundant(e, i, F.col("__given"))))
    count = lambda e, i: F.size(F.filter(F.slice("__e", F.lit(1), i + 1), lambda x: x["category"] == e["category"]))
    out = F.transform(
        "__e",
        lambda e, i: F.struct(
            F.concat(F.lit("pii_"), F.lower(e["category"]), F.lit("_"), count(e, i).cast("string")).alias("id"),
            e["category"].alias("category"),
            e["value"].alias("value"),
            mask(e["category"], count(e, i)).alias("mask"),
            *[e[n].alias(n) for n in ("risk", "source", "confidence", "box", "element", "selector")],
        ),
    )
    return rows.withColumn("entities", out).drop("__e", "__given")


def risk_count(entities: Column, risk: str) -> Column:
    return F.size(F.filter(entities, lambda e: e["risk"] == risk))


def exposure(high: Column, medium: Column, low: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - (high * 25 + medium * 10 + low * 5))


def coverage(detected: Column, redacted: Column, blocked: Column) -> Column:
    share = F.when(detected > 0, F.least(F.lit(100), js.half_up(redacted / F.when(detected > 0, detected) * 100))).otherwise(F.lit(100))
    return F.when(blocked, F.lit(0)).otherwise(share).cast("int")


def coverage_band(c: Column) -> Column:
    return F.when(c == 100, "full").when(c >= 70, "partial").otherwise("low")
