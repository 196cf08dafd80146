"""Checksums and word lists as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions import js

# The words of page furniture that are never personal data.
BRAND_WORDS = (
    "visa", "visa premium", "mastercard", "rupay", "amex", "american express",
    "discover", "maestro", "diners", "paypal", "google pay", "phonepe", "paytm",
    "two-factor", "2fa", "authentication", "active otp", "current login otp",
    "identity", "kyc", "verification", "sensitive", "verified", "verified kyc",
    "pci protected", "npci", "rbi", "secure", "npci / rbi secure", "saved payment cards",
    "saved upi", "linked bank accounts", "personal profile", "shopping cart",
    "recent orders", "my account", "card holder", "expires", "valid thru",
    "cvv", "cvc", "cid", "ifsc", "ifsc code", "a/c number", "account number",
    "primary upi id", "vpa", "refund bank account", "update kyc details",
    "update kyc", "aadhaar number", "permanent account number", "indian passport number",
    "account password", "delivery address", "phone number", "email address",
    "full name", "recipient full name",
)

# Common words that the contextual rules must not take.
STOP_WORDS = (
    "issued", "matter", "filed", "pending", "hearing", "notice", "order", "summons",
    "court", "suit", "police", "high", "civil", "criminal", "case", "action", "dispute",
    "record", "litigation", "bench", "tribunal", "session", "judiciary", "justice",
    "account", "balance", "number", "payment", "card", "expire", "valid", "total",
    "amount", "status", "delivery", "shipping", "billing", "customer",
    "client", "profile", "password", "security", "code", "digits", "verified",
)

# The Verhoeff multiplication and permutation tables, a digit string a row.
VERHOEFF_D = ("0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210")
VERHOEFF_P = ("0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the Luhn checksum."""
    ds = F.transform(F.split(F.reverse(number), ""), lambda d: d.cast("int"))
    doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def verhoeff(number: Column) -> Column:
    """Is the string a twelve-digit number that starts with 2 to 9, isn't one digit
    repeated, and passes the Verhoeff checksum."""
    n = js.digits(number)
    d, p = F.lit("".join(VERHOEFF_D)), F.lit("".join(VERHOEFF_P))
    pick = lambda table, at: F.substring(table, at + 1, F.lit(1)).cast("int")
    steps = F.transform(F.split(F.reverse(n), ""), lambda x, i: pick(p, i % 8 * 10 + x.cast("int")))
    check = F.aggregate(steps, F.lit(0), lambda c, x: pick(d, c * 10 + x))
    # The fold is only defined for digits, so the format is tested first.
    return F.when(n.rlike("^[2-9][0-9]{11}$") & ~n.rlike(r"^([0-9])\1{11}$"), check == 0).otherwise(F.lit(False))


def one_of(value: Column, words: tuple[str, ...]) -> Column:
    """Is the value one of the words; one pattern keeps plans of many rules small."""
    return value.rlike("^(?:" + "|".join(re.escape(w) for w in words) + r")\z")


def brand(value: Column) -> Column:
    return one_of(F.lower(js.trim(value)), BRAND_WORDS)


def stop_word(value: Column) -> Column:
    return one_of(F.lower(value), STOP_WORDS)
