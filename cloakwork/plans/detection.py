"""Queries over detection, resolution, redaction, the gate and the evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions import checks
from cloakwork.operators import detect, evaluate, redact, resolve
from cloakwork.operators.rules import CONTEXTUAL_RULES, LIVE_SECRET, RULES, SENSITIVE_MARKERS, Rule
from cloakwork.plans import duck
from cloakwork.sources import synthetic, tables

CORPUS = synthetic.corpus_sql()


def _rule_query(rule: Rule, values):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = synthetic.corpus(spark, sf_dir)
        return rows.select("src", "doc_id", F.posexplode(values(rule, F.col("text"))).alias("pos", "value"))

    return query


def _rule_sql(rule: Rule, values) -> str:
    return f"""with c as ({CORPUS}), f as (select src, doc_id, {values(rule, 'text')} as vs from c)
    select src, doc_id, cast(unnest(generate_series(0, len(vs) - 1)) as int) as pos, unnest(vs) as value from f where len(vs) > 0"""


def contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contextual layer alone: first of each value, with confidence by its number."""
    found = detect.with_confidence(detect.first_of(detect.contextual(F.col("text")), lambda f: F.lower(f["value"])))
    rows = synthetic.corpus(spark, sf_dir).select("src", "doc_id", F.posexplode(found).alias("pos", "f"))
    return rows.select("src", "doc_id", "pos", *(F.col(f"f.{n}").alias(n) for n in ("category", "value", "risk", "confidence")))


_CONTEXT = f"""c as ({CORPUS}), raw as (select src, doc_id, text, {duck.findings(CONTEXTUAL_RULES, 'text', 'ML_EDGE_MODEL')} as fs from c),
    each as (select src, doc_id, unnest(generate_series(1, len(fs))) as i, unnest(fs) as f from raw),
    firsts as (select *, row_number() over (partition by src, doc_id, lower(f.value) order by i) as r from each),
    numbered as (select src, doc_id, row_number() over (partition by src, doc_id order by i) as n, f.category as category, f.value as value, f.risk as risk, f.confidence as base from firsts where r = 1)"""

CONTEXTUAL_SQL = f"with {_CONTEXT} select src, doc_id, cast(n - 1 as int) as pos, category, value, risk, least(0.99, round(base + (n % 5) * 0.01, 2))::double as confidence from numbered"


def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synthetic.corpus(spark, sf_dir)
    found = detect.first_of(detect.contextual(F.col("text")), lambda f: F.lower(f["value"]))
    return rows.withColumn("f", found).select("src", "doc_id", detect.sensitivity(F.col("text"), F.col("f")).alias("sensitivity"))


SENSITIVITY_SQL = f"""with {_CONTEXT}, s as (select src, doc_id, least(100, 30 * count(*) filter (risk = 'HIGH') + 15 * count(*) filter (risk = 'MEDIUM') + 8 * count(*)) as x from numbered group by all)
    select c.src, c.doc_id, cast(case when {duck.trim('text')} = '' then 0 when {duck.like('text', SENSITIVE_MARKERS, True)} then greatest(85, coalesce(x, 0)) else coalesce(x, 0) end as int) as sensitivity
    from c left join s using (src, doc_id)"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.protect(synthetic.corpus(spark, sf_dir))


def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of the rulebook with its key."""
    rows = synthetic.corpus(spark, sf_dir).select("src", "doc_id", F.posexplode(detect.rulebook(F.col("text"))).alias("pos", "f"))
    return rows.select("src", "doc_id", "pos", F.col("f.category").alias("category"), F.col("f.value").alias("value"), resolve.canonical_key(F.col("f.category"), F.col("f.value")).alias("key"))


CANONICAL_SQL = f"""with c as ({CORPUS}), raw as (select src, doc_id, {duck.findings(RULES, 'text', 'RULEBOOK')} as fs from c),
    each as (select src, doc_id, cast(unnest(generate_series(0, len(fs) - 1)) as int) as pos, unnest(fs) as f from raw where len(fs) > 0)
    select src, doc_id, pos, f.category as category, f.value as value, {duck.key('f.category', 'f.value')} as key from each"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolved entities of every text, with masks."""
    rows = _entities(spark, sf_dir).select("src", "doc_id", F.posexplode_outer("entities").alias("pos", "e")).where("pos is not null")
    return rows.select("src", "doc_id", "pos", *(F.col(f"e.{n}").alias(n) for n in ("id", "category", "value", "mask", "risk", "source", "confidence")))


_LOW = lambda t: f"lower({duck.trim(t + '.value')})"
#: CTEs up to ``masked``: the entities of each text in order.
ENTITY_CTES = f"""{_CONTEXT},
    rules as (select src, doc_id, {duck.findings(RULES, 'text', 'RULEBOOK')} as fs from c),
    scanned as (
      select src, doc_id, 1 as layer, unnest(generate_series(1, len(fs))) as i, unnest(fs) as f from rules
      union all select src, doc_id, 2, n, {{'category': category, 'value': value, 'risk': risk, 'source': 'ML_EDGE_MODEL', 'confidence': least(0.99, round(base + (n % 5) * 0.01, 2))::double}} from numbered
    ),
    keyed as (select *, {duck.key('f.category', 'f.value')} as key from scanned),
    once as (select *, row_number() over (partition by src, doc_id, key order by layer, i) as r from keyed),
    stripped as (select src, doc_id, layer, i, f.category as category, {duck.stripped('f.value')} as value, f.risk as risk, f.source as source, f.confidence as confidence from once where r = 1),
    fit as (select *, {duck.key('category', 'value')} as key from stripped where {duck.admissible('category', 'value')}),
    merged as (
      select src, doc_id, key, min(layer * 100000 + i) as o, arg_min(category, layer * 100000 + i) as category,
        list_reduce(list(value order by layer, i), lambda a, b: case when length(b) > length(a) and {duck.like('b', '[+@ -]')} then b else a end) as value,
        arg_min(risk, layer * 100000 + i) as risk, arg_min(source, layer * 100000 + i) as source, max(confidence) as confidence
      from fit group by all
    ),
    held as (
      select m.* from merged m where not exists (
        select 1 from merged o where o.src = m.src and o.doc_id = m.doc_id and o.category = m.category
          and length({_LOW('m')}) < length({_LOW('o')}) and contains({_LOW('o')}, {_LOW('m')}))
    ),
    masked as (
      select *, row_number() over (partition by src, doc_id order by o) - 1 as pos, row_number() over (partition by src, doc_id, category order by o) as n from held
    )"""
ENTITIES_SQL = f"with {ENTITY_CTES} select src, doc_id, cast(pos as int) as pos, 'pii_' || lower(category) || '_' || n as id, category, value, {duck.mask('category', 'n')} as mask, risk, source, confidence from masked"


def risk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by risk, exposure and coverage of every text."""
    rows = _entities(spark, sf_dir)
    n = F.size("entities")
    cover = resolve.coverage(n, n, ~F.col("gate.is_safe"))
    return rows.select("src", "doc_id", n.alias("total"), "high_risk", "medium_risk", "low_risk", "exposure", cover.alias("coverage"), resolve.coverage_band(cover).alias("band"))


_GATE = f"""exempt as (
      select *, {duck.mask('category', 'n')} as mask,
        category = 'NAME' or {duck.trim('lower(value)')} in {duck.words(checks.BRAND_WORDS)} or {duck.like('lower(value)', redact.EXEMPT)} or (category = 'ADDRESS' and {duck.like('lower(value)', redact.EXEMPT_ADDRESS)}) as skip
      from masked
    ),
    folded as (
      select src, doc_id, list({{'v': value, 'm': mask}} order by length(value) desc, pos) filter (not skip and length(value) >= 2) as es, list(value) as vs,
        count(*) as total, count(*) filter (risk = 'HIGH') as high, count(*) filter (risk = 'MEDIUM') as medium, count(*) filter (risk = 'LOW') as low
      from exempt group by all
    ),
    redacted as (
      select c.src, c.doc_id, c.text, vs, coalesce(total, 0) as total, coalesce(high, 0) as high, coalesce(medium, 0) as medium, coalesce(low, 0) as low,
        case when es is null then c.text else list_reduce(list_prepend({{'v': '', 'm': c.text}}, es), lambda a, x: {{'v': '', 'm': regexp_replace(a.m, '(?i)' || regexp_escape(x.v), x.m, 'g')}}).m end as redacted
      from c left join folded using (src, doc_id)
    ),
    gated as (
      select *, {duck.like('redacted', LIVE_SECRET)} as secret, coalesce(len(list_filter(vs, lambda v: contains(redacted, v))), 0) > 0 as residue from redacted
    )"""

RISK_SQL = f"""with {ENTITY_CTES}, {_GATE}, x as (select *, case when secret or residue then 0 else 100 end as coverage from gated)
    select src, doc_id, cast(total as int) as total, cast(high as int) as high_risk, cast(medium as int) as medium_risk, cast(low as int) as low_risk,
      cast(greatest(0, 100 - (25 * high + 10 * medium + 5 * low)) as int) as exposure, cast(coverage as int) as coverage, case when coverage = 100 then 'full' when coverage >= 70 then 'partial' else 'low' end as band from x"""


def redact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select("src", "doc_id", "redacted")


REDACT_SQL = f"with {ENTITY_CTES}, {_GATE} select src, doc_id, redacted from gated"


def privacy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate in all three modes over every text."""
    rows = _entities(spark, sf_dir).withColumn("mode", F.explode(F.array(*map(F.lit, (redact.STRICT, redact.BALANCED, redact.PERMISSIVE)))))
    rows = rows.withColumn("g", redact.gate(F.col("redacted"), F.col("entities"), F.col("mode")))
    return rows.select("src", "doc_id", "mode", "g.is_safe", "g.action", "g.reason")


GATE_SQL = f"""with {ENTITY_CTES}, {_GATE}, modes as (select *, unnest(['STRICT', 'BALANCED', 'PERMISSIVE']) as mode from gated),
    a as (select *, case when secret then 1 when mode = 'STRICT' and high > 0 then 2 when residue then 3 else 0 end as k from modes)
    select src, doc_id, mode, k = 0 as is_safe, case k when 0 then 'PROCEED' when 2 then 'REQUIRE_USER_REVIEW' else 'BLOCK' end as action,
      case k when 1 then {duck.q(redact.SECRET_REASON)} when 2 then 'STRICT MODE: ' || high || ' high-risk sensitive entities (Pass/Card/Aadhaar) present on page.' when 3 then {duck.q(redact.LEFT_REASON)} end as reason from a"""


def firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one row for every document, whether it has findings or not."""
    rows = redact.protect(tables.documents(spark, sf_dir).select("doc_id", "source", "text"))
    return rows.select("doc_id", "source", F.size("entities").alias("total"), "high_risk", "medium_risk", "low_risk", "sensitivity", "exposure", F.col("gate.action").alias("action"), F.length("redacted").alias("redacted_chars"), F.sha2("redacted", 256).alias("redacted_sha256"))


FIREWALL_SQL = f"""with {ENTITY_CTES}, {_GATE}, s as (select src, doc_id, least(100, 30 * count(*) filter (risk = 'HIGH') + 15 * count(*) filter (risk = 'MEDIUM') + 8 * count(*)) as x from numbered group by all)
    select g.doc_id, d.source, cast(total as int) as total, cast(high as int) as high_risk, cast(medium as int) as medium_risk, cast(low as int) as low_risk,
      cast(case when {duck.trim('g.text')} = '' then 0 when {duck.like('g.text', SENSITIVE_MARKERS, True)} then greatest(85, coalesce(x, 0)) else coalesce(x, 0) end as int) as sensitivity,
      cast(greatest(0, 100 - (25 * high + 10 * medium + 5 * low)) as int) as exposure, case when secret or residue then 'BLOCK' else 'PROCEED' end as action,
      cast(length(redacted) as int) as redacted_chars, sha256(redacted) as redacted_sha256
    from gated g join documents d using (doc_id) left join s on s.src = g.src and s.doc_id = g.doc_id where g.src = 'documents'"""


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luhn and Verhoeff over numbers made of order keys."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    number = F.lpad((F.col("o_orderkey") * 7919 + 200000000000).cast("string"), 12, "0")
    return orders.select("o_orderkey", number.alias("number"), checks.luhn(number).alias("luhn"), checks.verhoeff(number).alias("verhoeff"))


CHECKSUM_SQL = f"""with n as (select o_orderkey, lpad(cast(o_orderkey * 7919 + 200000000000 as string), 12, '0') as number from orders)
    select o_orderkey, number, {duck.luhn('number')} as luhn, {duck.verhoeff('number')} as verhoeff from n"""


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection quality on derived texts, whose right findings are known by their keys:
    valid cards are those of keys not divisible by 4, valid Aadhaar numbers by 5, PANs of
    those divisible by 3."""
    rows = redact.protect(synthetic.people(spark, sf_dir))
    has = lambda c: F.exists("entities", lambda e: e["category"] == c)
    k = F.col("doc_id")
    cases = F.array(*(F.struct(F.lit(c).alias("category"), truth.alias("truth"), has(c).alias("found")) for c, truth in (("EMAIL", F.lit(True)), ("CARD", k % 4 != 0), ("AADHAAR", k % 5 != 0), ("PAN", (k % 3 == 0) | (k % 16 == 12)))))
    rows = rows.select(F.explode(cases).alias("x")).select("x.*")
    return evaluate.rates(rows.groupBy("category").agg(F.count_if(F.col("truth") & F.col("found")).alias("tp"), F.count_if(~F.col("truth") & F.col("found")).alias("fp"), F.count_if(F.col("truth") & ~F.col("found")).alias("fn")))


TRUTH_SQL = f"""with {ENTITY_CTES}, has as (select distinct doc_id, category from masked where src = 'people'),
    t as (select doc_id, c.category, case c.category when 'EMAIL' then true when 'CARD' then doc_id % 4 <> 0 when 'AADHAAR' then doc_id % 5 <> 0 else doc_id % 3 = 0 or doc_id % 16 = 12 end as truth
      from (select c_custkey as doc_id from customer) k, (values ('EMAIL'), ('CARD'), ('AADHAAR'), ('PAN')) c(category)),
    n as (select t.category, count(*) filter (truth and h.doc_id is not null) as tp, count(*) filter (not truth and h.doc_id is not null) as fp, count(*) filter (truth and h.doc_id is null) as fn
      from t left join has h on h.doc_id = t.doc_id and h.category = t.category group by 1),
    r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 1.0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 1.0 end as rc from n)
    select category, tp, fp, fn, round(p, 4)::double as precision, round(rc, 4)::double as recall, round(case when p + rc > 0 then 2 * p * rc / (p + rc) else 1.0 end, 4)::double as f1 from r"""


QUERIES = {
    "firewall": firewall,
    "eval_benchmark": evaluate.eval_benchmark,
    **{f"detect_{r.name}": _rule_query(r, detect.matches) for r in RULES},
    **{f"context_{r.name}": _rule_query(r, detect.contextual_matches) for r in CONTEXTUAL_RULES},
    "detect_contextual": contextual,
    "sensitivity_index": sensitivity,
    "canonical_keys": canonical_keys,
    "entities": entities,
    "risk_counts": risk_counts,
    "redact_texts": redact_texts,
    "privacy_gate": privacy_gate,
    "checksums": checksums,
    "ground_truth": ground_truth,
}

SQL = {
    "firewall": FIREWALL_SQL,
    "eval_benchmark": evaluate.SQL,
    **{f"detect_{r.name}": _rule_sql(r, duck.found) for r in RULES},
    **{f"context_{r.name}": _rule_sql(r, duck.context) for r in CONTEXTUAL_RULES},
    "detect_contextual": CONTEXTUAL_SQL,
    "sensitivity_index": SENSITIVITY_SQL,
    "canonical_keys": CANONICAL_SQL,
    "entities": ENTITIES_SQL,
    "risk_counts": RISK_SQL,
    "redact_texts": REDACT_SQL,
    "privacy_gate": GATE_SQL,
    "checksums": CHECKSUM_SQL,
    "ground_truth": TRUTH_SQL,
}
