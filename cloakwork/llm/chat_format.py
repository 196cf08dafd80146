"""Chat formatting: folds an event log of each conversation into messages and renders them.

Events are (conv_id, seq, turn, kind, role, text). ``delta`` appends text to its turn's
message; ``edit`` and ``regenerate`` replace what the message has so far by their text,
and later deltas append to that. Turns come in order; only DataFrame functions are used.

A message renders as ``<|role|>`` + role + ``<|text|>`` + text + ``<|end|>``. In roles and
texts ``&``, ``<`` and ``[`` are written ``&amp;``, ``&lt;`` and ``&lsqb;``, so no control
string of the template, nor ``</s>`` or ``[INST]`` of others, can be formed by a text, and
``read_back`` restores every text exactly. The loss mask covers assistants' texts.

Defined results: a null text, role or kind is an empty text, an empty role and a delta;
events of one turn and sequence number are ordered by kind, role and text; null sequence
numbers and turns come first; rows of a null conv_id are one conversation; the role of a
message is that of its first event since it was last replaced; extra columns are ignored;
an empty log gives no rows. One conversation is one output row, so its messages meet in
one task; messages of different conversations don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm import jobs

HEAD, MID, END = "<|role|>", "<|text|>", "<|end|>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
LOSS_ROLE = "assistant"
REPLACING = ("edit", "regenerate")


def escape(c: Column) -> Column:
    for plain, safe in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages. Partial sums run before the one
    shuffle by conversation and turn."""
    kind = F.coalesce("kind", F.lit("delta"))
    event = F.struct("seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = events.select(F.col("conv_id"), "turn", event.alias("e")).groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("e")).alias("es"))
    last = F.aggregate(F.transform("es", lambda e, i: F.when(e["kind"].isin(*REPLACING), i).otherwise(F.lit(0))), F.lit(0), lambda a, i: F.greatest(a, i))
    current = grouped.withColumn("es", F.slice("es", last + 1, F.size("es")))
    return current.select("conv_id", "turn", F.col("es")[0]["role"].alias("role"), F.array_join(F.transform("es", lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted): one row for each conversation."""
    turn = F.concat(F.lit(HEAD), escape(F.coalesce("role", F.lit(""))), F.lit(MID), escape(F.coalesce("text", F.lit(""))), F.lit(END))
    rows = messages.select("conv_id", F.struct("turn", turn.alias("s")).alias("m"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["s"]), "").alias("formatted"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Adds ``turns``, array<struct<role, text>>, parsed from ``formatted`` alone."""
    parts = F.split(F.col("formatted"), r"<\|end\|>")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        at = F.instr(p, MID)
        return F.struct(unescape(F.substring(p, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)).alias("role"), unescape(F.substring(p, at + len(MID), F.length(p))).alias("text"))

    return rendered.withColumn("turns", F.transform(parts, turn))


def as_events(conversations: DataFrame) -> DataFrame:
    """Each row of a finished conversation as the one event of its own message. Rows that
    share a turn are messages of their own, in the order of role and text."""
    kept = conversations.select("conv_id", "turn", "role", "text")
    return kept.select("conv_id", F.struct("turn", "role", "text", F.monotonically_increasing_id().alias("row")).alias("turn"), F.lit(0).alias("seq"), F.lit("delta").alias("kind"), "role", "text")


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold_events(events))


def op9(spark, sf_dir: str) -> DataFrame:
    jobs.prepare(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    turns = read_back(format_chats(as_events(rows.unionByName(planted))))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
),
wide as (select *, role || text as said from rows)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(23 + length(said) + 4 * (length(said) - length(replace(said, '&', ''))) + 3 * (length(said) - length(replace(said, '<', '')))
      + 5 * (length(said) - length(replace(said, '[', ''))))::bigint as formatted_chars
from wide group by conv_id
"""
