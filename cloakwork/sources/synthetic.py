"""A corpus with known findings, derived from customers by SQL that Spark and DuckDB share.

Each customer gives one text with values made from its key: addresses of all kinds, numbers
with right and, for some keys, wrong check digits, and labelled codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakwork.functions.checks import VERHOEFF_D, VERHOEFF_P
from cloakwork.sources import tables

#: The inverse of each digit in the table VERHOEFF_D.
_INVERSE = "0432156789"


def _digit(text: str, at: int | str) -> str:
    return f"cast(substr({text}, {at}, 1) as int)"


def _luhn_digit(payload: str, n: int) -> str:
    parts = []
    for i in range(n):
        d = _digit(payload, n - i)
        parts.append(f"(case when {d} > 4 then 2 * {d} - 9 else 2 * {d} end)" if i % 2 == 0 else d)
    return f"(10 - ({' + '.join(parts)}) % 10) % 10"


def people_sql(customers: str = "customer") -> str:
    """SQL for (doc_id, text)."""
    d, p = "".join(VERHOEFF_D), "".join(VERHOEFF_P)
    inner = f"""select c_custkey as k, c_name as name,
      '4' || lpad(cast((c_custkey * 7919 + 12345) % 1000000000 as string), 14, '53') as card,
      cast(20000000000 + (c_custkey * 104729) % 7999999999 as string) as uid
    from {customers}"""
    # The Verhoeff check digit, a digit of the payload at each level.
    level = f"select *, 0 as c0 from ({inner}) t0"
    for i in range(1, 12):
        q = f"cast(substr('{p}', {i % 8 * 10} + {_digit('uid', 12 - i)} + 1, 1) as int)"
        level = f"select *, cast(substr('{d}', c{i - 1} * 10 + {q} + 1, 1) as int) as c{i} from ({level}) t{i}"
    checked = f"""select k, name,
      card || cast(({_luhn_digit('card', 15)} + case when k % 4 = 0 then 1 else 0 end) % 10 as string) as card,
      uid || cast((cast(substr('{_INVERSE}', c11 + 1, 1) as int) + case when k % 5 = 0 then 1 else 0 end) % 10 as string) as uid
    from ({level}) t12"""
    key = lambda n, mod: f"lpad(cast(k % {mod} as string), {n}, '0')"
    extra = (
        "'Card security code: ' || " + key(3, 1000),
        "'Expiry: ' || " + "lpad(cast(k % 12 + 1 as string), 2, '0') || '/' || cast(2025 + k % 9 as string)",
        "'Your OTP is ' || " + key(6, 1000000) + " || '. Valid thru 11/29.'",
        "'Ship: Flat 402, Royal Palms, Green Park Extension, New Delhi 11' || " + key(4, 9999),
        "'Delivery address: ' || cast(k as string) || ' Hill Garden Circle, Pune\nUpdate location'",
        "'Delivering to Ghaziabad 201' || " + key(3, 1000) + " || ' today'",
        "'Noida 201' || " + key(3, 1000) + " || ' PIN: 411' || " + key(3, 1000),
        "'key sk-' || 'live' || lpad(cast(k as string), 24, 'ab9') || ' end'",
        "'UPI id user' || cast(k as string) || '@okaxis and pay' || cast(k as string) || '@paytm'",
        "'Passport no. J1' || " + key(5, 100000) + " || '7 and IFSC code HDFC0' || " + key(6, 1000000),
        "'Police FIR No. ' || cast(2020 + k % 5 as string) || '/' || cast(k as string) || ' and case no. issued'",
        "'Annual CTC is ₹' || cast(k % 90 + 5 as string) || ' LPA with ESOPs of ' || cast(k % 9000 + 100 as string) || ' shares'",
        "'Account number: ' || lpad(cast(k as string), 12, '73') || ', driving licence MH12 2011' || " + key(7, 10000000),
        "'ATM PIN: ' || " + key(4, 10000) + " || '; wallet balance: ₹' || cast(k % 900 as string) || ',250.00'",
        "'Contact 98****' || " + key(4, 10000) + " || ' or shr**' || cast(k as string) || '@mail.example.org'",
        "'Active OTP authentication heading, visa premium, order 525-1016217'",
    )
    cases = " ".join(f"when {i} then {e}" for i, e in enumerate(extra))
    return f"""select k as doc_id,
      'Customer ' || name || ' <' || lower(replace(name, '#', '.')) || '@shop' || cast(k % 7 as string) || '.example.com> phone +91 9'
      || {key(9, 1000000000)} || ', alt (' || cast(200 + k % 799 as string) || ') 555-' || {key(4, 10000)}
      || '. Aadhaar ' || substr(uid, 1, 4) || ' ' || substr(uid, 5, 4) || ' ' || substr(uid, 9, 4)
      || case when k % 3 = 0 then ', PAN ABCDE' || {key(4, 10000)} || 'F' else '' end
      || ', card ' || substr(card, 1, 4) || '-' || substr(card, 5, 4) || '-' || substr(card, 9, 4) || '-' || substr(card, 13, 4)
      || '. ' || case k % {len(extra)} {cases} else '' end as text
    from ({checked}) t13"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.dealt(spark, sf_dir, "customer", "c_custkey", "c_name").createOrReplaceTempView("cloakwork_customer")
    # The customers are dealt out before their texts are made. The second exchange keeps the long expression from being
    # copied into each use of the text; with a number, so that few small rows still are the work of all cores.
    return spark.sql(people_sql("cloakwork_customer")).repartition(tables.parts(spark), "doc_id")


def corpus_sql() -> str:
    """All texts that the detectors are queried over: documents and derived ones."""
    return f"select 'documents' as src, doc_id, coalesce(text, '') as text from documents union all select 'people', doc_id, text from ({people_sql()}) p"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = tables.documents(spark, sf_dir).select(F.lit("documents").alias("src"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.unionByName(people(spark, sf_dir).select(F.lit("people").alias("src"), "doc_id", "text"))
