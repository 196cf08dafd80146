"""Patterns are only run on texts that may hold what they find, and once."""

from pyspark.sql import functions as F

from cloakwork.functions import js
from cloakwork.operators import detect, redact
from cloakwork.operators.rules import CONTEXTUAL_RULES, RULES

#: A text for each way of the rules' words, in odd cases.
TEXTS = (
    "CVV: 123", "cvc 1234", "Security  Code: 123", "CARD code 321", "CVN#999", "EXPIRES: 08/29", "valid THRU 11/2029", "one-TIME password 123456", "OTP is 1234", "login CODE: 4321", "Flat 12, Some Long Garden Name 110016", "H. No 12 of the old Town 560001", "SHIPPING to New Town 201301", "PIN Code: 411001", "Zip 411001",
    "Postal PIN 411001", "CTC of 45 LPA", "Annual   Package is 20 lakhs", "NET worth: 3 crores", "Take-Home 5 k", "monthly Payout 9 usd", "ESOPs of 500 shares", "Stock Options 50 units", "Severance: 20 k", "FIR no. 12/2024", "Writ  Petition no. 9", "Docket 77", "CRIME no. 5", "Bank A/C 123456789", "ACCT no. 123456789",
    "saving ACCOUNT 123456789", "BANK IFSC HDFC0001234", "Pay via UPI a.b@Bank", "me@OKAXIS", "Indian PASSPORT J1234567", "DL no. MH12 20111234567", "Driving LICENSE MH12 20111234567", "MPIN: 4321", "refund AMOUNT: ₹ 500.00", "Pending Dues = $9", "İSTANBUL otp İ is 1234", "", "no words 12345",
)


def test_guards_and_words_lose_nothing(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    found = []
    for rules, values in ((RULES, detect.matches), (CONTEXTUAL_RULES, detect.contextual_matches)):
        for rule in rules:
            pattern = js.java(rule.pattern.replace(r"(?<!\d[-\s]?)", r"(?<!\d)(?<!\d[-\s])"), rule.ignore_case or values is detect.contextual_matches)
            bare = F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))) > 0
            may = detect.spared(rule, F.col("text"), F.array(F.lit("x")))
            found += [(rule.name, r["text"]) for r in texts.where(bare & (F.size(may) == 0)).collect()]
    assert found == []


def test_contextual_patterns_run_once(spark):
    rows = spark.range(1).select(F.concat(F.lit("CTC is 45 LPA "), "id").alias("text"))
    plan = rows.select(detect.first_of(detect.contextual(F.col("text")), lambda f: F.lower(f["value"])).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(CONTEXTUAL_RULES)


def test_trim_takes_white_space_of_all_scripts_without_a_pattern(spark):
    odd = "".join(map(chr, (0x20, 9, 10, 11, 12, 13, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
    texts = (f"{odd}a b{odd}", odd, "", None, "\u200b\u0085x\u0085")
    rows = spark.range(len(texts)).orderBy("id").select(js.trim(F.get(F.array(*map(F.lit, texts)), F.col("id").cast("int"))))
    assert [r[0] for r in rows.collect()] == ["a b", "", "", None, texts[-1]]
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_made_small_once_for_all_rules(spark):
    rows = spark.range(1).select(F.concat(F.lit("CTC is 45 LPA "), "id").alias("text"))
    for rules in (detect.contextual, detect.rulebook):
        plan = rows.select(rules(F.col("text")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(text") == 1, rules


def test_values_without_letters_need_no_pattern_of_their_own(spark):
    entities = "array(struct('4111-1111' as value, '[CARD_1]' as mask), struct('a.b$' as value, '$1' as mask), struct('(9) 8*' as value, '\\\\x' as mask), struct('éé9' as value, 'e' as mask))"
    row = spark.sql(f"select '4111-1111, A.B$ axb$ (9) 8* éé9 ÉÉ9 4111-1111' as t, {entities} as es")
    assert row.select(redact.redact(F.col("t"), F.col("es"))).first()[0] == "[CARD_1], $1 axb$ \\x e ÉÉ9 [CARD_1]"
    assert row.select(redact.redact(F.lit(None).cast("string"), F.col("es"))).first()[0] is None


def test_boundaries_know_ascii_words_by_the_class_of_their_own(spark):
    assert "A-Z" not in js.BOUNDARY
    texts = [("a1", True), ("éa1é", True), ("_a1", False), ("a1_", False), ("Za1", False), ("a19", False), ("-a1-", True), ("ſa1", True)]
    rows = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    for ignore_case in (False, True):
        assert [r[0] for r in rows.coalesce(1).select(js.matches(F.col("t"), r"(?:)\ba1\b", ignore_case)).collect()] == [w for _, w in texts]
