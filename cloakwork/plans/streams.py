"""Queries over logs of events: macros, the agent's loop and utterances, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators import macros
from cloakwork.streaming import missions, speech

#: Macros that an owner starts with.
DEFAULTS = (("m1", "Music", "Search tum hi ho on spotify", "music", True), ("m2", "Cart & Vault", "Open carts", "cart", True), ("m3", "E-Com", "Open amazon", "cart", True), ("m4", "Search", "Search for laptop", "search", True), ("m5", "Scroll", "Scroll up", "scroll", False))
TAGS = ("music", "MUSIC!", "e com", "E-Com", "cart & vault", "scroll", "new tag", "")
GAP_MINUTES = 90


def changes(events: DataFrame) -> DataFrame:
    """Events as a change log: what an event does follows from its number."""
    k = F.col("event_id")
    op = F.element_at(F.array(*map(F.lit, (macros.ADD, macros.TOGGLE, macros.EDIT, macros.TOGGLE, macros.DELETE, macros.TOGGLE, macros.ADD, "unknown", macros.RESET))), F.when(k % 97 == 0, 9).otherwise(k * 7 % 8 + 1).cast("int"))
    id_ = F.when(op == macros.ADD, F.concat(F.lit("e"), k.cast("string"))).otherwise(F.concat(F.lit("m"), (k % 5 + 1).cast("string")))
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (k % 8 + 1).cast("int"))
    return events.select(F.col("user_id").alias("owner"), k.alias("seq"), op.alias("op"), id_.alias("id"), tag.alias("tag"), F.concat(F.lit("do "), F.col("event_type")).alias("act"), F.lit("music").alias("icon"), (k % 3 == 0).alias("favourite"))


def macro_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's macros after all of the log; no SQL, as each change depends on those before."""
    return macros.folded(changes(spark.read.parquet(f"{sf_dir}/events.parquet")), DEFAULTS)


def outcomes(events: DataFrame) -> DataFrame:
    """Events as steps of a mission for each user and day."""
    kinds = {"error": missions.FAILED, "purchase": missions.CONFIRM, "signup": missions.FINISH}
    outcome = F.coalesce(*(F.when(F.col("event_type") == e, o) for e, o in kinds.items()), F.when(F.col("event_id") % 23 == 0, missions.BLOCKED), F.when(F.col("event_id") % 11 == 0, missions.FILLED), F.lit(missions.DONE))
    return events.select(F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("mission"), F.col("event_id").alias("pos"), outcome.alias("outcome"))


def agent_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missions.folded(outcomes(spark.read.parquet(f"{sf_dir}/events.parquet")))


LOOP_SQL = """with o as (select user_id || '/' || strftime(ts, '%Y-%m-%d') as mission, event_id as pos,
      case event_type when 'error' then 'failed' when 'purchase' then 'confirm' when 'signup' then 'finish' else case when event_id % 23 = 0 then 'blocked' when event_id % 11 = 0 then 'filled' else 'done' end end as outcome from events),
    l as (select mission, list(outcome order by pos)[1:5] as os from o group by 1),
    e as (select mission, os, list_min(list_filter(generate_series(1, len(os)), lambda i: os[i] in ('blocked', 'unsafe', 'confirm', 'finish', 'failed'))) as e from l)
    select mission, cast(coalesce(e, len(os)) as int) as steps, cast(len(list_filter(os[1:coalesce(e, len(os))], lambda x: x not in ('blocked', 'unsafe', 'confirm', 'filled'))) as int) as logged,
      case when e is not null then os[e] when len(os) = 5 then 'capped' else 'running' end as status from e"""


def spoken(events: DataFrame) -> DataFrame:
    """Events as parts that a user speaks."""
    return events.select(F.col("user_id").alias("speaker"), "ts", F.col("event_id").alias("pos"), (F.col("event_id") % 3 != 0).alias("is_final"), F.col("event_type").alias("text"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.utterances(spoken(spark.read.parquet(f"{sf_dir}/events.parquet")), f"{GAP_MINUTES} minutes")


UTTERANCE_SQL = f"""with p as (select user_id as speaker, ts, event_id as pos, event_id % 3 <> 0 as fin, event_type as text, ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval {GAP_MINUTES} minute as fresh from events),
    g as (select *, sum(case when fresh then 1 else 0 end) over (partition by speaker order by ts, pos rows unbounded preceding) as n from p)
    select speaker, min(ts) as began, max(ts) + interval {GAP_MINUTES} minute as sent, count(*) as parts, string_agg(text, ' ' order by not fin, ts, pos) as text from g group by speaker, n having bool_or(fin)"""

QUERIES = {"macro_table": macro_table, "agent_loop": agent_loop, "utterances": utterances}
SQL = {"agent_loop": LOOP_SQL, "utterances": UTTERANCE_SQL}
