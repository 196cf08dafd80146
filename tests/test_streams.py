"""State over streams against batches of the same rows, and the change log against plain lists."""

import datetime
import random

import pandas as pd
import pytest

from cloakwork.operators import macros
from cloakwork.plans import streams
from cloakwork.streaming import missions, speech

DATA = "/root/testdata/sf0.001"


def written(spark, rows, schema, path, files):
    """The rows in order, as so many files."""
    size = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * size : (i + 1) * size]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path / f"b{i:02d}"))
    return [str(path / f"b{i:02d}") for i in range(files) if (path / f"b{i:02d}").exists()]


def streamed(spark, folders, schema, make, mode, tmp_path):
    """Every batch of the stream in turn; what is sent, batch by batch."""
    source, got = tmp_path / "source", []
    source.mkdir()
    query = make(spark.readStream.schema(schema).parquet(str(source))).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: got.append(df.toPandas())).start()
    import os
    import shutil

    try:
        for k, folder in enumerate(folders):
            for f in os.listdir(folder):
                if f.endswith(".parquet"):
                    shutil.copy(f"{folder}/{f}", source / f"{k:03d}-{f}")
            query.processAllAvailable()
        query.processAllAvailable()
    finally:
        query.stop()
    return got


def brute_loop(rows, most=5):
    by = {}
    for mission, pos, outcome in rows:
        if mission is not None and pos is not None:
            own = by.setdefault(mission, {})
            own[pos] = min(own.get(pos, outcome), outcome)
    out = {}
    for mission, own in by.items():
        steps = logged = 0
        status = "running"
        for pos in sorted(own):
            if steps >= most:
                status = "capped"
                break
            steps += 1
            logged += own[pos] not in missions.UNEXECUTED
            if own[pos] in missions.ENDS:
                status = own[pos]
                break
        if status == "running" and steps >= most:
            status = "capped"
        out[mission] = (steps, logged, status)
    return out


@pytest.fixture(scope="module")
def loop_rows():
    rng = random.Random(3)
    rows = [(f"m{rng.randrange(40)}", i, rng.choices(("done", "filled", *missions.ENDS), (60, 10, 2, 2, 3, 4, 3))[0]) for i in range(300)]
    return [*rows[:50], rows[20], *rows[50:], (None, 5, "done"), ("m1", None, "done"), ("lone", 1, "done")]


def test_the_loop_over_a_table(spark, loop_rows):
    table = spark.createDataFrame(loop_rows, "mission string, pos long, outcome string")
    assert {r["mission"]: (r["steps"], r["logged"], r["status"]) for r in missions.folded(table).collect()} == brute_loop(loop_rows)
    assert missions.folded(table.where("false")).count() == 0


def test_the_loop_over_a_stream_is_that_over_its_rows(spark, loop_rows, tmp_path):
    schema = "mission string, pos long, outcome string"
    folders = written(spark, loop_rows, schema, tmp_path, 5)
    got = pd.concat(streamed(spark, folders, schema, missions.looped, "update", tmp_path))
    last = {m: (s, n, st) for m, s, n, st in got.itertuples(index=False)}
    assert last == brute_loop(loop_rows)


def test_utterances_over_a_stream_and_late_parts(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, at(0), 1, False, "go"), (1, at(1), 2, True, "open"), (1, at(2.5), 3, True, "gmail"), (2, at(3), 4, False, "hm"), (1, at(9), 5, True, "stop"), (2, at(30), 6, True, "late end"), (1, at(1.5), 7, True, "too late"), (3, at(60), 8, True, "x"), (3, at(61), 9, True, None), (None, at(62), 10, True, "y"), (4, at(100), 11, True, "z")]
    schema = "speaker long, ts timestamp, pos long, is_final boolean, text string"
    table = spark.createDataFrame(rows, schema)
    batch = sorted((r["speaker"], r["parts"], r["text"]) for r in speech.utterances(table.where("pos <> 7")).collect())
    assert batch == [(1, 1, "stop"), (1, 3, "open gmail go"), (2, 1, "late end"), (3, 2, "x"), (4, 1, "z")]
    folders = written(spark, rows, schema, tmp_path, len(rows))
    got = pd.concat(streamed(spark, folders, schema, lambda s: speech.utterances(s, late="5 seconds"), "append", tmp_path))
    # The last session is still open; the late part came when its session had been sent.
    assert sorted((r.speaker, r.parts, r.text) for r in got.itertuples()) == batch[:-1]


def brute_macros(log, defaults):
    by = {}
    for owner, _, op, id_, tag, act, icon, fav in sorted(log, key=lambda r: (r[0], r[1])):
        own = by.setdefault(owner, [list(d) for d in defaults])
        key = macros.normal_key
        if op == "reset":
            by[owner] = [list(d) for d in defaults]
        elif op == "delete":
            by[owner] = [m for m in own if m[0] != id_]
        elif op == "toggle" and any(m[0] == id_ for m in own):
            target = next(m for m in own if m[0] == id_)
            on = not target[4]
            for m in own:
                if m is not target and on and key(m[1]) == key(target[1]):
                    m[4] = False
            target[4] = on
        elif op in ("add", "edit") and tag.strip() and act.strip() and (op == "edit") == any(m[0] == id_ for m in own):
            for m in own:
                if m[0] != id_ and fav and key(m[1]) == key(tag):
                    m[4] = False
            if op == "add":
                own.append([id_, tag.strip(), act.strip(), icon, fav])
            else:
                next(m for m in own if m[0] == id_)[1:] = [tag.strip(), act.strip(), icon, fav]
    return {(o, i): tuple(m) for o, own in by.items() for i, m in enumerate(own)}


def test_macros_after_a_log(spark):
    rng = random.Random(5)
    log = [(rng.randrange(6), i, rng.choice(("add", "add", "edit", "toggle", "toggle", "delete", "reset" if i % 50 == 0 else "odd")), f"m{rng.randrange(9)}", rng.choice(streams.TAGS), rng.choice(("do it", "", "go")), "i", rng.random() < 0.5) for i in range(600)]
    schema = "owner long, seq long, op string, id string, tag string, act string, icon string, favourite boolean"
    table = spark.createDataFrame(log, schema)
    got = [macros.folded(table.repartition(n), streams.DEFAULTS).collect() for n in (1, 7)]
    rows = [{(r["owner"], r["pos"]): (r["id"], r["tag"], r["act"], r["icon"], r["favourite"]) for r in g} for g in got]
    assert rows[0] == rows[1] == brute_macros(log, streams.DEFAULTS)
    favourites = [(o, macros.normal_key(m[1])) for (o, _), m in rows[0].items() if m[4]]
    assert len(favourites) == len(set(favourites)) > 3
    assert macros.folded(table.where("false")).count() == 0


def test_the_stored_table_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "macros")
    assert macros.stored(spark, path).count() == 0
    first = macros.folded(streams.changes(spark.read.parquet(f"{DATA}/events.parquet")), streams.DEFAULTS)
    macros.replace(first, path)
    n = macros.stored(spark, path).count()
    macros.replace(macros.stored(spark, path).where("favourite"), path)
    kept = macros.stored(spark, path).count()
    assert 0 < kept < n
    (tmp_path / "macros" / "v=9").mkdir()
    assert macros.stored(spark, path).count() == kept
    macros.replace(macros.stored(spark, path).limit(1), path)
    assert macros.stored(spark, path).count() == 1 and sorted(p.name for p in (tmp_path / "macros").iterdir()) == ["v=2", "v=3", "v=9"]
