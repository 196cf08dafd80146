"""Queries that act on the elements of pages: offline plans, safety, autofill; and an image's channels. Goals and actions are
dealt to the pages by their numbers. Their SQL takes the elements of the recursive walk (plans/trees.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.dialect import Duck, Spark
from cloakwork.operators import act, elements, rank, redact
from cloakwork.operators import goals as g
from cloakwork.plans import duck, pages, trees
from cloakwork.plans.goals import GOALS
from cloakwork.sources import forms

KEYS = ("src", "page_id")
TEXTS = tuple(text for _, text, _ in GOALS)
PROMPTS = ("set city to Pune, name = Rahul and phone: 98765", "fill email as x@y.example", "", "set middle to M, notes: none", "auto fill my details")


def _dealt(column: str, rows: tuple) -> Column:
    """One of the rows for each page, by its number."""
    return F.get(F.array(*map(F.lit, rows)), F.pmod("page_id", F.lit(len(rows))).cast("int")).alias(column)


def _cases(rows: tuple) -> str:
    return f"case page_id % {len(rows)} " + " ".join(f"when {i} then {duck.q(str(r))}" for i, r in enumerate(rows)) + " end"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.elements(forms.all_pages(spark, sf_dir), *KEYS)


_COMBINED = "lower(concat(text, ' ', aria, ' ', placeholder, ' ', id, ' ', name))"


def _plan(d: Spark) -> tuple[str, ...]:
    """The columns of a plan, given goal, place, fill, scroll, and the best element's idx, tag and selector."""
    entry = "tag in ('input', 'textarea')"
    return (
        f"case when place <> '' then 'navigate' when fill then 'autofill' when idx is not null then case when {entry} then 'type' else 'click' end when scroll then 'scroll' else 'finish' end as action",
        f"case when place <> '' then place when fill then null when idx is not null and {entry} then {g.query_py(d, 'goal')} end as value",
        "case when place = '' and not fill then idx end as target_index", "case when place = '' and not fill then selector end as selector",
        f"cast(case when place <> '' or fill then 0.95 when idx is not null then case when {entry} then 0.88 else 0.90 end when scroll then 0.85 else 0.75 end as double) as confidence",
    )


def _facts(d: Spark) -> tuple[str, ...]:
    return f"{act.plan_target(d, 'goal')} as place", f"{d.match('goal', g.AUTOFILL)} as fill", "contains(lower(goal), 'scroll') as scroll"


def page_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One action for each page's goal over its own elements: navigate, autofill, the best element, scroll or finish."""
    goals = forms.all_pages(spark, sf_dir).select(*KEYS, _dealt("goal", TEXTS)).selectExpr("*", *_facts(Spark()))
    scored = _found(spark, sf_dir).select(*KEYS, "idx", "tag", "selector", "text", F.expr(_COMBINED).alias("combined"), F.lower(_dealt("goal", TEXTS)).alias("goal"))
    scored = scored.withColumn("score", F.expr(rank.plan_score(Spark(), "goal", "combined", "text", "tag"))).where("score > 0")
    best = scored.groupBy(*KEYS).agg(F.max(F.struct("score", (-F.col("idx")).alias("i"), "tag", "selector")).alias("b"))
    rows = goals.join(best, list(KEYS), "left").select(*goals.columns, (-F.col("b.i")).alias("idx"), "b.tag", "b.selector")
    return rows.selectExpr(*KEYS, *_plan(Spark()))


PLANS_SQL = f"""with recursive {trees.ELEMENT_CTES}, asked as (select src, page_id, {_cases(TEXTS)} as goal from source),
    scored as (select src, page_id, idx, tag, selector, {rank.plan_score(Duck(), 'goal', 'combined', 'text', 'tag')} as score from (select el.src, el.page_id, idx, tag, selector, text, {_COMBINED} as combined, lower(goal) as goal from el join asked using (src, page_id)) x),
    best as (select * from scored where score > 0 qualify row_number() over (partition by src, page_id order by score desc, idx) = 1),
    facts as (select a.src, a.page_id, goal, {', '.join(_facts(Duck()))}, idx, tag, selector from asked a left join best using (src, page_id))
    select src, page_id, {', '.join(_plan(Duck()))} from facts"""


def _hit(e: str = "") -> str:
    """Does the action mean an element; ``e`` names a struct of it."""
    return f"(target_index = {e}idx or (target_index < 0 and target_text <> '' and (contains(lower(concat({e}text, ' ', {e}aria, ' ', {e}id, ' ', {e}name)), lower(trim(target_text))) or ({e}text <> '' and contains(lower(trim(target_text)), lower({e}text))))))"


_HIT = _hit()


def _verdict(d: Spark) -> tuple[str, ...]:
    joined = "concat(target_text, ' ', coalesce(text, ''), ' ', coalesce(aria, ''), ' ', coalesce(id, ''), ' ', coalesce(name, ''), ' ', thought)"
    free, secret = f"action in {tuple(act.SAFE_ACTIONS)}", "coalesce(is_sensitive, false)"
    return "action", f"case when {free} then null else idx end as element", f"not {free} and ({secret} or {act.critical(d, joined)}) as confirm", f"case when {free} then 'safe' when {secret} then 'sensitive' when {act.critical(d, joined)} then 'critical' else 'safe' end as verdict"


_ACTION = {n: tuple(row[i] for row in pages.ACTIONS) for i, n in ((1, "action"), (2, "target_index"), (3, "target_text"), (4, "thought"))}


def page_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page's action needs a confirmation, by the element of the page that it means."""
    # The page's elements stay in its row: its action is asked over their array, in their order.
    rows = elements.with_tree(forms.all_pages(spark, sf_dir), *KEYS).select(*KEYS, elements.element_array(F.col("page")).alias("found"), *(_dealt(n, values) for n, values in _ACTION.items()))
    rows = rows.withColumn("e", F.get(F.expr(f"filter(found, e -> {_hit('e.')})"), F.lit(0)))
    return rows.select(*KEYS, *_ACTION, *(F.col("e")[n].alias(n) for n in ("idx", "text", "aria", "id", "name", "is_sensitive"))).selectExpr(*KEYS, *_verdict(Spark()))


SAFETY_SQL = f"""with recursive {trees.ELEMENT_CTES}, actions as (select src, page_id, {', '.join(f"{_cases(rows) if n != 'target_index' else 'cast(' + _cases(rows) + ' as int)'} as {n}" for n, rows in _ACTION.items())} from source),
    met as (select a.*, idx, text, aria, id, name, is_sensitive from actions a join el using (src, page_id) where {_HIT} qualify row_number() over (partition by src, page_id order by idx) = 1),
    rows as (select a.*, idx, text, aria, id, name, is_sensitive from actions a left join (select src, page_id, idx, text, aria, id, name, is_sensitive from met) m using (src, page_id))
    select src, page_id, {', '.join(_verdict(Duck()))} from rows"""


_DESCRIPTOR = "lower(concat(name, ' ', id, ' ', placeholder, ' ', aria, '  ', type))"


def _filled(d: Spark) -> tuple[str, ...]:
    vault = "case field " + " ".join(f"when '{f}' then '{v}'" for f, v in pages.VAULT) + " end"
    value = f"case when pair is not null then substr(pair, length(split_part(pair, '=', 1)) + 2) else {vault} end"
    return "case when pair is not null then split_part(pair, '=', 1) else field end as field", f"{value} as value"


def page_autofill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is filled in on each page: the prompt's own pairs first, then the vault; of a select the option that is
    the value or shares its text."""
    d = Spark()
    # A prompt's pairs are read once for its page.
    pages = forms.all_pages(spark, sf_dir).select(*KEYS, "html", _dealt("prompt", PROMPTS)).withColumn("pairs", F.expr(g.pairs(d, "prompt", by_key=False)))
    rows = elements.elements(pages, *KEYS, "pairs").where("tag in ('input', 'textarea', 'select') and type not in ('radio', 'checkbox')")
    rows = rows.select(*KEYS, "idx", "tag", "type", "options", "pairs", F.expr(_DESCRIPTOR).alias("descriptor"))
    # Nested lets keep each name's patterns from being copied into all uses of it; the filter on the value reads a generated row.
    filled = d.let("pair", act.custom_pair(d, "pairs", "descriptor"), d.let("field", act.vault_field(d, "descriptor", "type"), f"struct({', '.join(_filled(d))})"))
    rows = rows.select(*KEYS, "idx", "tag", "options", F.posexplode_outer(F.array(F.expr(filled))).alias("at", "f")).select(*KEYS, "idx", "tag", "options", "f.field", "f.value").where("value is not null")
    low = F.lower("value")
    fits = F.transform("options", lambda o: (F.lower(o["value"]) == low) | F.contains(F.lower(o["label"]), low) | F.contains(low, F.lower(o["label"])))
    rows = rows.withColumn("option", F.when(F.col("tag") == "select", F.array_position(fits, F.lit(True)).cast("int") - 1)).where("tag <> 'select' or option >= 0")
    return rows.select(*KEYS, "idx", "field", "value", "option", F.expr(f"concat(field, ': ', case when tag = 'select' then value else {act.audit_value('value')} end)").alias("audit"))


AUTOFILL_SQL = f"""with recursive {trees.ELEMENT_CTES}, asked as (select src, page_id, {_cases(PROMPTS)} as prompt from source),
    fields as (select el.*, {_DESCRIPTOR} as descriptor, {g.pairs(Duck(), 'prompt', by_key=False)} as pairs from el join asked using (src, page_id) where tag in ('input', 'textarea', 'select') and type not in ('radio', 'checkbox')),
    paired as (select src, page_id, i, idx, tag, {act.custom_pair(Duck(), 'pairs', 'descriptor')} as pair, {act.vault_field(Duck(), 'descriptor', 'type')} as field from fields),
    filled as (select src, page_id, i, idx, tag, {', '.join(_filled(Duck()))} from paired),
    chosen as (select f.src, f.page_id, f.idx, min(o.o) as o from filled f join option_of o using (src, page_id, i) where f.tag = 'select' and (lower(o.value) = lower(f.value) or contains(lower(o.label), lower(f.value)) or contains(lower(f.value), lower(o.label))) group by all)
    select src, page_id, idx, field, value, cast(o as int) as "option", field || ': ' || case when tag = 'select' then value else {act.audit_value('value')} end as audit from filled left join chosen using (src, page_id, idx) where value is not null and (tag <> 'select' or o is not null)"""


def image_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels of images of up to four pixels, made of the orders' numbers."""
    k = F.col("o_orderkey")
    pixels = F.transform(F.sequence(F.lit(0), (k % 4) * 4 + 3), lambda i: F.pmod(k * 31 + i * 57, F.lit(256)))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.transform(redact.channels(pixels), lambda x: F.round(x, 6)).alias("values")).select("o_orderkey", F.array_join(F.transform("values", lambda x: F.format_number(x, 4)), " ").alias("channels"))


CHANNEL_SQL = """with p as (select o_orderkey, o_orderkey % 4 + 1 as n, list_transform(generate_series(0, (o_orderkey % 4) * 4 + 3), lambda i: (o_orderkey * 31 + i * 57) % 256) as px from orders),
    v as (select o_orderkey, c, i, (px[i * 4 + c + 1] / 255.0 - [0.485, 0.456, 0.406][c + 1]) / [0.229, 0.224, 0.225][c + 1] as x from (select *, unnest(generate_series(0, n - 1)) as i from p) q, (select unnest([0, 1, 2]) as c) t)
    select o_orderkey, string_agg(printf('%.4f', round(x, 6)), ' ' order by c, i) as channels from v group by 1"""

QUERIES = {"page_plans": page_plans, "page_safety": page_safety, "page_autofill": page_autofill, "image_channels": image_channels}
SQL = {"page_plans": PLANS_SQL, "page_safety": SAFETY_SQL, "page_autofill": AUTOFILL_SQL, "image_channels": CHANNEL_SQL}
