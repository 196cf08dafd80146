"""What elements of a page hold by the words of their id or class, or by the area that they stand in, and the form of
their text.

Columns over a page's tree: no shuffle, and no work for elements whose attributes have none of the words and that
stand in no area of cards or dossiers. An element's text is all that it shows; an input has its value. Headings, badges,
labels, footers and what isn't shown hold nothing. Layout is unknown.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import checks, js, tree
from cloakwork.operators.elements import FOOTER, NO_ADDRESS, UNSHOWN, attribute, rows_of
from cloakwork.operators.places import HEADINGS as TITLES


@dataclass(frozen=True)
class Detector:
    """Words of an id and of a class, the form of the text, and what is made of it."""

    category: str
    ids: str
    classes: str
    form: str
    masked: str
    risk: str
    inputs: bool = False
    check: str = ""
    children: int = 1 << 30
    area: str = ""


# What the attributes are called, the forms and the masks.
EMAIL_FORM = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IFSC_FORM = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
PHONE_FORM = r"(?:\+91[-.\s]?)?[6-9]\d{4}[-.\s]?\d{5}|(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
DETECTORS = (
    Detector("EMAIL", "email", "email", EMAIL_FORM, "[REDACTED_EMAIL]", "MEDIUM"),
    Detector("PHONE", "phone|mobile", "phone|mobile", PHONE_FORM, "[REDACTED_PHONE]", "MEDIUM"),
    Detector("CVV", "cvv|cvc", "cvv|cvc", r"^\d{3,4}$", "███", "HIGH", inputs=True),
    Detector("CARD_EXPIRY", "exp", "exp", r"^(?:0[1-9]|1[0-2])[/\-](?:20)?\d{2}$", "[CARD_EXPIRY]", "HIGH", inputs=True, area="cards"),
    Detector("ADDRESS", "^glow-ingress-line[12]$|location-slot|address|city|pincode|postal|zip", "delivery-location|address|city|pincode|postal|zip", "", "[REDACTED_LOCATION]", "MEDIUM", check="address"),
    Detector("OTP", "val-otp|otp-code", "otp-val|otp-code", r"^\d{4,8}$", "██████", "HIGH", inputs=True),
    Detector("UPI", "upi|vpa", "upi", r"[a-zA-Z0-9.\-_]{2,64}@[a-zA-Z]{2,64}", "[REDACTED_UPI]", "HIGH"),
    Detector("BANK_ACCOUNT", "ifsc|bank-ac|account-num", "ifsc|bank-ac", IFSC_FORM, "[REDACTED_IFSC]", "MEDIUM"),
    Detector("BANK_ACCOUNT", "ifsc|bank-ac|account-num", "ifsc|bank-ac", r"\b\d{9,18}\b", "[REDACTED_BANK_AC]", "HIGH", check="no_ifsc"),
    Detector("PASSPORT", "passport", "passport", r"^[A-PR-WYa-pr-wy][1-9]\d\s?\d{4}[1-9]$", "[REDACTED_PASSPORT]", "HIGH"),
    Detector("CARD", "card-num|card_num", r"card-num|cc-num|cc_num|(?:^|\s)card-number(?:\s|$)", "", "[REDACTED_CARD]", "HIGH", check="card", children=1),
    Detector("AADHAAR", "aadhaar|aadhar|uidai", "aadhaar|aadhar|uidai", "", "[REDACTED_AADHAAR]", "HIGH", check="aadhaar", children=1),
    Detector("PAN", "pan", "pan", r"^\s*(?:[A-Z]\s*){5}(?:[0-9]\s*){4}[A-Z]\s*$", "[REDACTED_PAN]", "HIGH", children=1),
    Detector("PASSWORD", "val-pass|password", "password", r"^[•*●x█]{4,}$|••••", "████████", "HIGH"),
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "label", "th", "thead")
PLACE_ID = r"\b(?:ingress|delivery-location|location-slot)\b"
PLACE_NAME = r"\b(?:address|street|delivery-address|shipping-address|pincode|zipcode|postal-code|postal|zip|pin|city)\b"
PLACE_TAIL = r"\s*(?:\r?\n)+\s*(?:update|change|select)\s+location\b.*$"
NO_PLACE = NO_ADDRESS + r"|^(?:update location|change location|select your address|choose your location|select location|add address|manage address)$"
PLACE_DIGITS = r"\b[1-9][0-9]{5}\b|\b\d{5}\b"
PLACE_WORDS = r"\b(?:to|in|at)\s+[A-Za-z]"
PLACE_CAPITAL = r"\b[A-Z][a-z]+"
PAY, PAY_MASK = r"\b(?:CTC|LPA|salary|annual\s+CTC|ESOPs?)\b", "[REDACTED_COMPENSATION]"
LAW, LAW_MASK = r"\b(?:FIR|court\s+summons|civil\s+suit|litigation)\b", "[REDACTED_LEGAL_CASE]"


def _fits(d: Detector, text: Column) -> Column:
    number = js.digits(text)
    if d.check == "card":
        return F.length(number).between(13, 19) & checks.luhn(number)
    if d.check == "aadhaar":
        return (F.length(number) == 12) & checks.verhoeff(number)
    fits = js.matches(text, d.form)
    return fits & ~js.matches(text, IFSC_FORM) if d.check == "no_ifsc" else fits


def _place(names: Column, text: Column) -> tuple[Column, Column]:
    """The place without what follows it, and whether it is one."""
    shop = js.matches(names, PLACE_ID, True)
    place = js.trim(js.replace(text, PLACE_TAIL, "", True))
    holds = js.matches(place, PLACE_DIGITS) | js.matches(place, PLACE_WORDS, True) | js.matches(place, PLACE_CAPITAL)
    return place, (shop | js.matches(names, PLACE_NAME, True)) & F.length(place).between(3, 150) & ~js.matches(place, NO_PLACE, True) & (~shop | holds)


#: Areas whose elements are read whatever they are called, and the selectors of these areas.
CARDS, DOSSIERS = ".credit-card, .payment-cards", "[class*='dossier' i], [class*='unstructured' i]"
WORDS = sorted({w.strip("^$") for d in DETECTORS for w in ("ingress-line" if "glow" in x else x for x in (d.ids + "|" + d.classes).split("|")) if w and "(" not in w and "\\" not in w})
NAMED = ", ".join(f"[{a}*='{w}' i]" for a in ("id", "class") for w in WORDS) + ", [style*='border-left']"
PAGE = tree.spec({"footer": FOOTER, "unshown": UNSHOWN, "titles": TITLES, "cards": CARDS, "dossiers": DOSSIERS, "search": "form[role='search'], [role='search'], [role='searchbox']"}, (NAMED, CARDS + ", " + DOSSIERS), silent=("footer", "unshown"), around=("cards", "dossiers"), paths=False)
DOSSIER_CHILDREN, PLACE_CHILDREN = 1, 2


def attribute_findings(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, category, value, masked, risk), a row for each detector that an element meets; pos is
    its place among the page's elements. ``pages`` has the keys and ``html``. A null or empty page has no
    rows; repeated pages and repeated values give their rows again."""
    page = F.col("page")
    inside = lambda n, area: PAGE.within(n, area)
    wanted = lambda n: (n["kind"] == 1) | inside(n, "cards") | inside(n, "dossiers")
    seen = F.filter(page["nodes"], lambda n: wanted(n) & ~inside(n, "footer") & ~inside(n, "unshown") & ~inside(n, "titles") & ~n["tag"].isin(*HEADINGS))

    def read(n: Column) -> Column:
        raw = F.when(n["tag"] == "input", attribute(n, "value")).when(n["tag"] == "textarea", F.coalesce(n["content"], F.lit(""))).otherwise(F.substring(page["text"], n["start"] + 1, n["stop"] - n["start"]))
        own = {"node": n["node"], "tag": n["tag"], "children": n["children"], "text": js.trim(raw), **{a: attribute(n, a) for a in ("id", "class", "style")}}
        # An area's own element stands around those that it is asked for.
        bits = {a: inside(n, a) & ~_names_area(n, a) for a in ("cards", "dossiers")}
        return F.struct(*(c.alias(k) for k, c in own.items()), *(c.alias(k) for k, c in bits.items()), inside(n, "search").alias("search"))

    rows = rows_of(pages.select(*keys, tree.parsed(F.col("html"), PAGE).alias("page")), F.transform(seen, read), *keys).select(*keys, F.col("x.node").alias("pos"), *(F.col("x")[c].alias(c) for c in ("tag", "children", "text", "id", "class", "style", "cards", "dossiers", "search")))
    rows = rows.where("text <> ''").where(~checks.brand(F.col("text")))
    text, entry = F.col("text"), F.col("tag").isin("input", "textarea")
    found = []
    for d in DETECTORS:
        named = js.matches(F.col("id"), d.ids, True) | js.matches(F.col("class"), d.classes, True)
        named = (named | F.col(d.area)) if d.area else named
        value = text
        if d.check == "address":
            names = F.lower(F.concat_ws(" ", "id", "class"))
            value, fits = _place(names, text)
            fits = fits & ~F.col("search") & ((F.col("children") <= PLACE_CHILDREN) | js.matches(names, PLACE_ID, True))
        else:
            fits = _fits(d, text) & (F.col("children") <= d.children)
        least = 1 if d.category in ("OTP", "CVV") else 2
        found.append(F.when(named & (F.lit(True) if d.inputs else ~entry) & (F.length(value) >= least) & fits, F.struct(F.lit(d.category).alias("category"), value.alias("value"), F.lit(d.masked).alias("masked"), F.lit(d.risk).alias("risk"))))
    set_off = (F.contains("style", F.lit("border-left")) | F.col("dossiers")) & (F.col("children") <= DOSSIER_CHILDREN) & text.rlike("[0-9]")
    fact = lambda c, m: F.struct(F.lit(c).alias("category"), text.alias("value"), F.lit(m).alias("masked"), F.lit("HIGH").alias("risk"))
    found.append(F.when(set_off & js.matches(text, PAY, True), fact("FINANCIAL", PAY_MASK)).when(set_off & js.matches(text, LAW, True), fact("LEGAL", LAW_MASK)))
    rows = rows.select(*keys, "pos", F.explode_outer(F.array_compact(F.array(*found))).alias("f")).where("f is not null")
    return rows.select(*keys, "pos", "f.*")


def _names_area(n: Column, area: str) -> Column:
    """Is a node the area's own element."""
    classes = attribute(n, "class")
    return js.matches(classes, r"(?:^|\s)(?:credit-card|payment-cards)(?:\s|$)") if area == "cards" else js.matches(classes, "dossier|unstructured", True)
