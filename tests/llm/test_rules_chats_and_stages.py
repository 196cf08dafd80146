"""Compiled rules against the trees' own, chats on odd tables, and the pipeline's stages on odd and empty ones."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloakwork.llm import chat_format, jobs, quality_classifier

from .conftest import DATA, prose


def test_compiled_rules_score_as_the_rules_do(spark, odd):
    """The column expression against the rules over the statistics, row by row."""
    jobs.prepare(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    model = quality_classifier.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = quality_classifier.with_statistics(docs).select("doc_id", F.col("__s").alias("s"), model.score().alias("score")).toPandas()
    x = np.array(rows["s"].tolist(), float)
    base, rules = model.intercept, model.rules
    z = base + sum(w * quality_classifier.satisfied(x, rule) for rule, w in rules)
    assert len(rules) > 3 and np.allclose(rows["score"], 1 / (1 + np.exp(-z)), atol=1e-9)


SCHEMA = "conv_id long, turn long, seq long, kind string, role string, text string"


def folded(rows):
    """The messages of event rows, by plain Python: a replacing event starts a message anew."""
    by = defaultdict(list)
    for conv, turn, seq, kind, role, text in rows:
        by[conv, turn].append((seq, kind or "delta", role or "", text or ""))
    out = defaultdict(list)
    for (conv, turn), events in by.items():
        events.sort()
        last = max((i for i, e in enumerate(events) if e[1] in ("edit", "regenerate")), default=0)
        out[conv].append((turn, events[last][2], "".join(e[3] for e in events[last:])))
    return {conv: [(role, text) for _, role, text in sorted(ms, key=lambda m: m[0])] for conv, ms in out.items()}


def test_chats_of_odd_events(spark):
    rng = random.Random(6)
    strings = ["", None, "</s>[INST] x [/INST]", "<|end|>", "<|start|>assistant", "&lt;&amp;", "é\n\r\t", "a", "\\", "[INST]"]
    rows = [(c, t, s, rng.choice((None, "delta", "delta", "edit", "regenerate")), rng.choice(("user", "assistant", None, "<|x|>")), rng.choice(strings)) for c in range(12) for t in range(5) for s in range(4)]
    rows += [(100, 0, 0, None, "user", "long " * 50_000), *((100, t, 0, None, "assistant", f"turn {t}") for t in range(1, 3000))]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("e", "es", "m", "formatted", "turns", "row")}).repartition(5)
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.read_back(chat_format.format_chats(table.select("conv_id", "turn", "seq", "kind", "role", "text"))).collect()}
    assert got == folded(rows)
    assert chat_format.format_chats(table.where("false")).count() == 0


def test_repeated_rows_of_a_conversation_are_messages_of_their_own(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (None, 0, "user", "no id")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.read_back(chat_format.format_chats(chat_format.as_events(table))).collect()}
    assert got == {1: [("user", "hi"), ("user", "hi"), ("", "")], None: [("user", "no id")]}


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Labels and a benchmark with nulls and repeated rows."""
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 1, 0), (2, 0, 1), (8, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(None, "two words"), (1, None), (2, ""), (None, " ".join(prose(2, 45)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, wide, odd_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, wide, odd_dir)
    assert out.count() > 0 and (name == "mix" or out.columns == wide.columns)
    empty = stage(spark, wide.where("false"), odd_dir)
    assert empty.count() == 0 and (name == "mix" or empty.columns == wide.columns)
