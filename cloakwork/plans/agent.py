"""Queries around an agent, and their SQL, written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.dialect import Duck
from cloakwork.operators import act, agent
from cloakwork.operators.rules import LIVE_SECRET
from cloakwork.plans import detection, duck, trees
from cloakwork.sources import forms as pages

KEYS = ("src", "page_id")


def plan_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbound rows of every page, with its text and elements redacted."""
    return agent.payloads(pages.all_pages(spark, sf_dir), *KEYS)


_ENTITIES = detection.ENTITY_CTES.replace(detection.CORPUS, "select src, page_id as doc_id, text from bodies")
_FOLD = lambda x: f"case when {x} = '' then null when es is null then {x} else list_reduce(list_prepend({{'v': '', 'm': {x}}}, es), lambda a, y: {{'v': '', 'm': regexp_replace(a.m, '(?i)' || regexp_escape(y.v), y.m, 'g')}}).m end"
_FIELD = act.element_category(Duck(), "lower(name || ' ' || id || ' ' || placeholder || ' ' || aria || ' ' || role)", "tag", "type", "name", "role", "value", "name || ' ' || id || ' ' || placeholder || ' ' || aria")
_LINKED = "tag in ('input', 'textarea') and length(trim(value)) >= 3 and len(list_filter(coalesce(vs, []), lambda v: length(v) >= 3 and (contains(lower(trim(value)), lower(v)) or contains(lower(v), lower(trim(value)))))) > 0"
PAYLOAD_SQL = f"""with recursive {trees.ELEMENT_CTES},
    bodies as (select s.src, s.page_id, {trees.plain("coalesce(string_agg(x.x, '' order by x.i), '')")} as text from source s left join said x using (src, page_id) group by all), {_ENTITIES}, {detection._GATE},
    k as (select el.*, es, is_sensitive or ({_FIELD}) is not null or ({_LINKED}) or (tag = 'input' and code and regexp_matches(value, '^[0-9]{{1,8}}$')) as hide from el left join folded f on f.src = el.src and f.doc_id = el.page_id),
    s as (select *, case when hide then '[SENSITIVE_FIELD]' else coalesce({_FOLD('text')}, '') end as t2, case when hide then aria else {_FOLD('aria')} end as a2,
      case when placeholder = '' then null when hide then '[REDACTED_INPUT]' else {_FOLD('placeholder')} end as p2 from k),
    one as (select src, page_id, idx, type, value, concat_ws(chr(10), t2, a2, p2, type, id, name, selector) as line, concat('{{"index":', idx, ',"tag":', to_json(tag), ',"text":', to_json(t2), case when a2 is not null then ',"ariaLabel":' || to_json(a2) else '' end,
      case when p2 is not null then ',"placeholder":' || to_json(p2) else '' end, ',"type":', to_json(type), ',"id":', to_json(id), ',"name":', to_json(name), ',"selector":', to_json(selector), '}}') as j from s),
    js as (select src, page_id, '[' || string_agg(j, ',' order by idx) || ']' as js, string_agg(line, chr(10) order by idx) as lines, list(value) filter (type = 'password' and length(value) >= 4) as pws from one group by all),
    ms as (select src, doc_id, string_agg({duck.mask('category', 'n')}, ',' order by pos) as masks from masked group by all),
    outs as (select g.*, js, masks, pws, redacted || chr(10) || coalesce(lines, '') as leaving from gated g left join js on js.src = g.src and js.page_id = g.doc_id left join ms on ms.src = g.src and ms.doc_id = g.doc_id)
    select src, doc_id as page_id, substr(redacted, 1, 1600) as sanitized_text, coalesce(js, '[]') as elements, substr(redacted, 1, 180) || '...' as preview, coalesce(masks, '') as masks, cast(length(redacted) as int) as bytes_sent, cast(total as int) as detected,
      cast(high as int) as high_risk, cast(greatest(0, 100 - (25 * high + 10 * medium + 5 * low)) as int) as exposure,
      cast(case when {duck.like('leaving', LIVE_SECRET)} or len(list_filter(coalesce(vs, []), lambda v: contains(leaving, v))) > 0 or len(list_filter(coalesce(pws, []), lambda v: contains(leaving, v))) > 0 then 1 else 0 end as int) as blocked from outs"""

#: Replies as a model writes them: fenced, bare, broken, and with actions that don't exist.
_REPLY = """case k % 7 when 0 then '```json
{"thought":"go on","action":"click","targetIndex":' || k || ',"confidence":0.5}
```' when 1 then '{"thought":"look","action":"scroll","direction":"down","amount":550}' when 2 then '```
{"thought":"t","action":"type","value":"v' || k || '"}```' when 3 then '{"thought":"x","action":"explode"}' when 4 then 'no json' when 5 then '{"action":"wait"}' else '  {"thought":"up","action":"scroll","direction":"sideways"}' end"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))


def parse_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("k", F.expr(_REPLY.replace("\n", "\\n")).alias("reply"))
    return rows.select(F.col("k").alias("reply_id"), agent.parsed_reply(F.col("reply")).alias("p")).select("reply_id", F.col("p").isNotNull().alias("valid"), "p.action", "p.targetIndex", "p.value", "p.direction", "p.amount", "p.confidence")


REPLY_SQL = f"""with r as (select k, {_REPLY} as reply from (select o_orderkey as k from orders) o),
    b as (select k, trim(regexp_replace(regexp_replace(reply, '^\\s*```(?:json)?', ''), '```\\s*$', ''), ' ' || chr(10)) as j from r),
    p as (select k, case when json_valid(j) then json(j) end as j from b),
    v as (select *, j is not null and j->>'thought' is not null and coalesce(j->>'action', '') in {duck.words(agent.ACTIONS)} and coalesce(j->>'direction', 'up') in ('up', 'down', 'top', 'bottom') as ok from p)
    select k as reply_id, ok as valid, case when ok then j->>'action' end as action, case when ok then cast(j->>'targetIndex' as int) end as "targetIndex", case when ok then j->>'value' end as value, case when ok then j->>'direction' end as direction,
      case when ok then cast(j->>'amount' as int) end as amount, case when ok then coalesce(cast(j->>'confidence' as double), 0.95) end as confidence from v"""

_BODY = """'{"goal":"g' || k || '","title":"t","url":"u","sanitizedText":"s"' || case k % 4 when 0 then '' when 1 then ',"safeElements":[]' when 2 then ',"safeElements":[{"index":1,"tag":"a","text":"x"},{"index":2,"tag":"input","text":"","name":"n"}]' else ',"safeElements":[{"tag":"a","text":"no index"}]' end || '}'"""


def plan_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("k").alias("request_id"), agent.parsed_request(F.expr(_BODY)).alias("p"))
    return rows.select("request_id", F.col("p").isNotNull().alias("valid"), "p.goal", F.when(F.col("p").isNotNull(), F.size("p.safeElements")).alias("elements"))


REQUEST_SQL = "select o_orderkey as request_id, o_orderkey % 4 in (1, 2) as valid, case when o_orderkey % 4 in (1, 2) then 'g' || o_orderkey end as goal, cast(case o_orderkey % 4 when 1 then 0 when 2 then 2 end as int) as elements from orders"


def voice_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as recognition results: every third part is interim, and some wake the agent."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = F.concat(F.when((F.col("turn") == 0) & (F.col("conv_id") % 3 == 0), "Hey Nova, ").otherwise(""), F.substring(F.coalesce("text", F.lit("")), 1, 40), F.when(F.col("conv_id") % 4 == 1, " th ").otherwise(""))
    return agent.transcripts(rows.select("conv_id", F.col("turn").alias("pos"), (F.col("turn") % 3 != 2).alias("is_final"), said.alias("text")), "conv_id")


TRANSCRIPT_SQL = f"""with p as (select conv_id, turn, turn % 3 <> 2 as fin, case when turn = 0 and conv_id % 3 = 0 then 'Hey Nova, ' else '' end || substr(coalesce(text, ''), 1, 40) || case when conv_id % 4 = 1 then ' th ' else '' end as x from conversations),
    t as (select conv_id, {duck.trim("coalesce(string_agg(x, '' order by turn) filter (fin), '') || ' ' || coalesce(string_agg(x, '' order by turn) filter (not fin), '')")} as transcript from p group by 1),
    w as (select *, regexp_matches(transcript, {duck.q('(?i)' + agent.WAKE)}) as woken from t)
    select conv_id, transcript, {duck.trim(f"regexp_replace(transcript, {duck.q('(?i)' + agent.FRAGMENT)}, '')")} as spoken, woken, case when woken then {duck.trim(f"regexp_extract(transcript, {duck.q('(?i)' + agent.WAKE_COMMAND)}, 1)")} else '' end as command from w"""


def screen_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made of order lines: held to size, on a screen of 1280 by 720 or not, and their seals."""
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", k.alias("k"))
    box = F.struct((k * 37 % 1600 - 150.5).alias("x"), (k * 53 % 1000 - 120.25).alias("y"), (k * 29 % 700 / 1.0).alias("width"), (k * 31 % 400 / 2).alias("height"))
    category = F.get(F.array(*map(F.lit, ("EMAIL", "AVATAR", "CARD", "CVV"))), (k % 4).cast("int"))
    rows = rows.withColumns({"category": category, "raw": box}).withColumn("b", agent.held_box(F.col("category"), F.col("raw")))
    seal = agent.seal(F.col("category"), F.col("k") % 2 == 0, F.col("b.width"), F.col("b.height"), F.lit(1.25))
    return rows.select("l_orderkey", "l_linenumber", "category", "b.x", "b.y", "b.width", "b.height", agent.on_screen(F.col("b"), F.lit(1280), F.lit(720)).alias("visible"), agent.avatar(F.col("raw")).alias("is_avatar"), seal.alias("s")).select("*", "s.label", "s.font").drop("s")


BOX_SQL = """with l as (select l_orderkey, l_linenumber, l_orderkey * 7 + l_linenumber as k from lineitem),
    r as (select *, k * 37 % 1600 - 150.5 as rx, k * 53 % 1000 - 120.25 as ry, k * 29 % 700 as rw, (k * 31 % 400)::double / 2 as rh, ['EMAIL', 'AVATAR', 'CARD', 'CVV'][k % 4 + 1] as category from l),
    b as (select *, cast(floor(rx + 0.5) as int) as x, cast(floor(ry + 0.5) as int) as y, cast(floor(least(rw, 480) + 0.5) as int) as width, cast(floor(case when category = 'AVATAR' then least(rh, 280) else least(rh, 60) end + 0.5) as int) as height from r)
    select l_orderkey, l_linenumber, category, x, y, width, height, width > 0 and height > 0 and y > -height and y < 720 and x > -width and x < 1280 as visible, rw >= 24 and rw <= 320 and rh >= 24 and rh <= 320 as is_avatar,
      case when category = 'AVATAR' then '🔒 [BLURRED: FACE / AVATAR]' when width < 60 then '🔒 ' || left(category, 3) else '🔒 [' || case when width < 110 then '' when width < 160 then 'MASKED: ' else 'SHIELDED: ' end || category || case when k % 2 = 0 then ' [ML]' else '' end || ']' end as label,
      cast(case when category = 'AVATAR' then 11 else greatest(9, least(12, floor(least(height * 0.55, 13.75) + 0.5))) end as int) as font from b"""


def mission_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of one day as a mission's log."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("pos"), F.col("event_type").alias("action"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))
    return agent.mission_log(rows, "user_id", "day")


LOG_SQL = """select user_id, strftime(ts, '%Y-%m-%d') as day, '{"status":"' || case when count(*) filter (event_type = 'error') = 0 then 'completed' else 'partial' end || '","totalSteps":' || count(*) || ',"completedSteps":' || count(*) filter (event_type <> 'error')
    || ',"steps":[' || string_agg('{"stepIndex":' || event_id || ',"action":"' || event_type || '","status":"' || case when event_type = 'error' then 'failed' else 'completed' end || '"}', ',' order by event_id) || ']}' as log from events group by 1, 2"""

QUERIES = {"plan_payloads": plan_payloads, "parse_replies": parse_replies, "plan_requests": plan_requests, "voice_transcripts": voice_transcripts, "screen_boxes": screen_boxes, "mission_log": mission_log}
SQL = {"plan_payloads": PAYLOAD_SQL, "parse_replies": REPLY_SQL, "plan_requests": REQUEST_SQL, "voice_transcripts": TRANSCRIPT_SQL, "screen_boxes": BOX_SQL, "mission_log": LOG_SQL}
