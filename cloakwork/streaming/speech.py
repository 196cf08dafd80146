"""Silence debounce: a speaker's parts are sent together once nothing has come for a while.

A session ends when the gap has passed without another part; it is sent if some part is final. Over a stream
the watermark says how late a part may come; a later one is dropped, as its session may be sent already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import js

GAP = "2 seconds"


def utterances(parts: DataFrame, gap: str = GAP, late: str | None = None) -> DataFrame:
    """(speaker, began, sent, parts, text) of parts (speaker, ts, pos, is_final, text), a table or, with ``late``, a stream."""
    rows = parts.where("speaker is not null and ts is not null")
    rows = rows.withWatermark("ts", late) if late else rows
    part = F.struct(~F.col("is_final"), "ts", "pos", F.coalesce("text", F.lit("")).alias("text"))
    said = rows.groupBy("speaker", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("parts"), F.max("is_final").alias("any_final"), F.array_sort(F.collect_list(part)).alias("said"))
    text = js.trim(F.array_join(F.transform("said", lambda p: p["text"]), " "))
    return said.where("any_final").select("speaker", F.col("w.start").alias("began"), F.col("w.end").alias("sent"), "parts", text.alias("text")).where("text <> ''")
