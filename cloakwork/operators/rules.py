"""The detectors' rule tables, written in ECMAScript's dialect.

A rule's value is its first group, or the whole match where it has none. ``guard`` is a
cheap pattern without which the rule cannot match; it spares most rows the rule's own. So are ``words``, of which
every match holds one, in any case: a search for them costs a fraction of a pattern of many ways.
"""

from __future__ import annotations

from dataclasses import dataclass

# The patterns, risks and confidences that results depend on.
NOT_ADDRESS = r"\b(?:otp|auth|authentication|authenticat[a-z]*|factor|2fa|verification|code|login|current|order|invoice|tracking|card|pass|pin|valid|minutes|seconds)\b"
NOT_PIN = r"\b(?:otp|auth|authentication|authenticat[a-z]*|factor|2fa|verification|code|login|current|order|invoice|tracking|card|pass|valid|minutes|seconds)\b"
UPI_HANDLES = "okhdfcbank|okaxis|oksbi|okicici|ybl|ibl|axl|paytm|upi|apl|barodampay|pnb|postbank|idfcbank|freecharge|federal|rbl|kotak|sbi|hdfcbank|icici|axisbank"
AADHAAR_SHAPE = r"[2-9]\d{3}[-\s]?\d{4}[-\s]?\d{4}"


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    risk: str
    pattern: str
    ignore_case: bool = False
    check: str | None = None
    guard: str = "[0-9@]"
    confidence: float = 0.99
    needs_digit: bool = False
    words: tuple[str, ...] = ()

    @property
    def group(self) -> int:
        """1 if there is a capture group."""
        p = self.pattern.replace("\\(", "").replace("(?", "")
        return int("(" in p)


# The rulebook; the guards are our own.
RULES = (
    Rule("email", "EMAIL", "LOW", r"\b[A-Za-z0-9._%+*•x\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", check="email", guard="@"),
    Rule("phone_in", "PHONE", "MEDIUM", r"(?:\+91[\-.\s]?)?[6-9][\d*•x]{3,4}[\-.\s]?[\d*•x]{4,5}\b", check="phone_in", guard=r"[6-9][0-9*•x]{3}"),
    Rule("phone_us", "PHONE", "MEDIUM", r"\b(?:\+1[\-.\s]?)?\(?[2-9]\d{2}\)?[\-.\s][2-9]\d{2}[\-.\s]\d{4}\b", guard=r"[2-9][0-9]{2}\)?[^0-9A-Za-z][2-9][0-9]{2}"),
    Rule("aadhaar", "AADHAAR", "HIGH", r"(?<!\d[-\s]?)\b[2-9]\d{3}[-\s]?\d{4}[-\s]?\d{4}\b(?![-\s]?\d)", check="verhoeff", guard="[2-9][0-9]{3}"),
    Rule("pan", "PAN", "HIGH", r"\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b", guard="[A-Z]{5}[0-9]{4}"),
    Rule("card", "CARD", "HIGH", r"\b(?:\d{4}[\-\s]?){3}\d{4}\b|\b(?:\d{4}[\-\s]?){2}\d{4}[\-\s]?\d{3}\b", check="card", guard="[0-9]{4}[^0-9A-Za-z]?[0-9]{4}"),
    Rule("cvv", "CVV", "HIGH", r"\b(?:cvv|cvc|security\s*code|card\s*code|cvn)\s*[:#\-]?\s*([0-9]{3,4})\b", True, words=("cvv", "cvc", "code", "cvn")),
    Rule("expiry", "CARD_EXPIRY", "HIGH", r"\b(?:exp(?:iry|ires)?|valid\s*(?:thru|through|till))\s*[:#\-]?\s*((?:0[1-9]|1[0-2])[\/\-](?:20)?\d{2})\b", True, words=("exp", "valid")),
    Rule("otp", "OTP", "HIGH", r"\b(?:otp|one[\- ]?time[\- ]?password|verification\s*code|auth\s*code|security\s*code|login\s*code|code\s*is)\s*(?:is|:|-)?\s*([0-9]{4,8})\b", True, words=("otp", "password", "code")),
    Rule("address_street", "ADDRESS", "MEDIUM", r"\b(?:Flat\s+\d+|House\s+No|Plot\s+No|H\.?\s*No|Block\s+[A-Z0-9]+|Sector\s+\d+|Phase\s+\d+|Floor\s+\d+|Apartments?|Palms?|Residency|Vihar|Colony|Enclave|Nagar|Marg|Road|Street|Lane|Avenue)\b[^\n\r<]{8,90}(?:\b[1-9][0-9]{5}\b|\b\d{5}(?:-\d{4})?\b|[A-Za-z]+(?:\s+[A-Za-z]+)?\s+\d{5,6})", True, "address", guard="[0-9]{5}"),
    Rule("address_label", "ADDRESS", "MEDIUM", r"\b(?:delivery\s+|shipping\s+|billing\s+|residential\s+|home\s+)?address\s*[:#\-]?\s*([^\n\r<]{12,110})", True, "address", guard="(?i)address"),
    Rule("address_deliver", "ADDRESS", "MEDIUM", r"\b(?:delivering|deliver(?:y)?|ship(?:ping)?|send)\s+(?:to|in|at)\s+([A-Za-z\s,\-]{2,35}?\s+\b[1-9][0-9]{5}\b)", True, "address", guard="[1-9][0-9]{5}", words=("deliver", "ship", "send")),
    Rule("address_city", "ADDRESS", "MEDIUM", r"\b([A-Z][a-zA-Z\s]{2,20}[ \t]+\b[1-9][0-9]{5}\b)", check="address", guard="[1-9][0-9]{5}"),
    Rule("address_pin", "ADDRESS", "MEDIUM", r"\b(?:pin(?:\s*code)?|postal(?:\s*(?:code|pin))?|zip(?:\s*code)?)\s*[:#\-]?\s*([1-9][0-9]{5})\b", True, "address_pin", guard="[1-9][0-9]{5}", words=("pin", "postal", "zip")),
    Rule("secret", "SECRET", "HIGH", r"\b(?:sk-[A-Za-z0-9_\-]{20,}|ghp_[A-Za-z0-9]{20,}|AIza[0-9A-Za-z\-_]{35}|eyJ[A-Za-z0-9\-_=]+\.[A-Za-z0-9\-_=]+\.?[A-Za-z0-9\-_.+\/=]*)\b", guard="sk-|ghp_|AIza|eyJ"),
    Rule("upi", "UPI", "HIGH", rf"\b[a-zA-Z0-9.\-_]{{2,64}}@({UPI_HANDLES})\b", True, guard=f"(?i)@(?:{UPI_HANDLES})"),
    Rule("passport", "PASSPORT", "HIGH", r"\b[A-PR-WYa-pr-wy][1-9]\d\s?\d{4}[1-9]\b", check="passport", guard="[A-Za-z][1-9][0-9]"),
    Rule("ifsc", "BANK_ACCOUNT", "MEDIUM", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", guard="[A-Z]{4}0"),
)

# The contextual rules.
CONTEXTUAL_RULES = (
    Rule("salary", "FINANCIAL", "HIGH", r"\b(?:ctc|salary|annual\s+package|net\s+worth|in-hand|take-home|compensation|monthly\s+payout)\s*(?:is|of|:|[\-=])?\s*([₹$€£]?\s*\d+(?:[.,]\d+)?\s*(?:lpa|lakhs?|crores?|k|m|usd|inr|eur|per\s+annum|per\s+month|\/year|\/mo)\b)", True, confidence=0.95, needs_digit=True, words=("ctc", "salary", "package", "worth", "in-hand", "take-home", "compensation", "payout")),
    Rule("equity", "FINANCIAL", "HIGH", r"\b(?:esops?|equity\s+grant|stock\s+options?|bonus|severance)\s*(?:is|of|:|[\-=])?\s*([₹$€£]?\s*\d+(?:[.,]\d+)?\s*(?:lpa|shares?|units?|k|usd|inr)\b)", True, confidence=0.93, needs_digit=True, words=("esop", "equity", "stock", "bonus", "severance")),
    Rule("legal", "LEGAL", "HIGH", r"\b(?:fir\s*(?:no\.?|#)|case\s*(?:no\.?|#)|writ\s+petition\s*(?:no\.?|#)|suit\s*(?:no\.?|#)|docket\s*(?:no\.?|#)?|crime\s*no\.?)\s*[:#\-]?\s*([a-z0-9\/\-]*\d[a-z0-9\/\-]*)", True, confidence=0.97, needs_digit=True, words=("fir", "case", "writ", "suit", "docket", "crime")),
    Rule("account", "BANK_ACCOUNT", "HIGH", r"\b(?:bank\s+(?:a\/c|account)|account\s+no\.?|account\s+number|acct\s+no\.?|saving\s+account)\s*[:#\-]?\s*(\d{9,18})\b", True, confidence=0.96, needs_digit=True, words=("account", "acct", "bank")),
    Rule("labelled_ifsc", "BANK_ACCOUNT", "MEDIUM", r"\b(?:ifsc\s*(?:code)?|bank\s+ifsc)\s*[:#\-]?\s*([A-Z]{4}0[A-Z0-9]{6})\b", True, confidence=0.98, needs_digit=True, words=("ifsc",)),
    Rule("labelled_upi", "UPI", "HIGH", r"\b(?:upi\s*(?:id|vpa)?|pay\s+via\s+upi|bhim\s+upi)\s*[:#\-]?\s*([a-zA-Z0-9.\-_]{2,256}@[a-zA-Z]{2,64})\b", True, guard="@", confidence=0.97, words=("upi",)),
    Rule("labelled_passport", "PASSPORT", "HIGH", r"\b(?:passport\s*(?:no\.?|number)|indian\s+passport)\s*[:#\-]?\s*([A-PR-WYa-pr-wy][1-9]\d\s?\d{4}[1-9])\b", True, confidence=0.95, needs_digit=True, words=("passport",)),
    Rule("licence", "PAN", "HIGH", r"\b(?:driving\s+licen[sc]e|dl\s*no\.?)\s*[:#\-]?\s*([A-Z]{2}[\-\s]?[0-9]{2,4}[\-\s]?[0-9]{7,11})\b", True, confidence=0.94, needs_digit=True, words=("licen", "dl")),
    Rule("pin", "PASSWORD", "HIGH", r"\b(?:atm\s*pin|security\s*pin|secret\s*pin|transaction\s*pin|mpin)\s*[:#\-]?\s*(\d{4,6})\b", True, confidence=0.98, needs_digit=True, words=("pin",)),
    Rule("balance", "FINANCIAL", "MEDIUM", r"\b(?:wallet\s+balance|refund\s+amount|account\s+balance|pending\s+dues)\s*(?:is|:|[\-=])?\s*([₹$€£]\s*[\d,]+(?:\.\d{2})?)", True, confidence=0.95, needs_digit=True, words=("balance", "refund", "dues")),
)

# The detector of the evaluation: looser, and a list of its own.
EVALUATION_RULES = (
    Rule("email", "EMAIL", "LOW", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    Rule("phone", "PHONE", "MEDIUM", r"(?:\+91[\-.\s]?)?[6-9]\d{4}[\-.\s]?\d{5}\b|(?:\+?1[\-.\s]?)?\(?\d{3}\)?[\-.\s]?\d{3}[\-.\s]?\d{4}\b"),
    Rule("aadhaar", "AADHAAR", "HIGH", r"\b[2-9]\d{3}[\-\s]?\d{4}[\-\s]?\d{4}\b"),
    Rule("pan", "PAN", "HIGH", r"\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b"),
    Rule("secret", "SECRET", "HIGH", r"\b(?:sk-[A-Za-z0-9_\-]{20,}|ghp_[A-Za-z0-9]{20,}|AIza[0-9A-Za-z\-_]{35})\b"),
    Rule("card", "CARD", "HIGH", r"\b(?:\d{4}[\-\s]?){3}\d{4}\b|\b(?:\d{4}[\-\s]?){2}\d{4}[\-\s]?\d{3}\b", check="card"),
)

SENSITIVE_MARKERS = r"\b(?:otp|cvv|one[\- ]?time[\- ]?password|security\s*code|net\s*banking|atm\s*pin|aadhaar|pan\s*card)\b"
LIVE_SECRET = r"\b(?:sk-[A-Za-z0-9_\-]{20,}|ghp_[A-Za-z0-9]{20,}|AIza[0-9A-Za-z\-_]{35})\b"
