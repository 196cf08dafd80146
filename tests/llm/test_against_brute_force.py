"""The operators against plain Python over small tables."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import chat_format, decontamination, jobs, mixing, near_dedup, queries, quality_rules, secret_scan, substring_dedup, textops, token_counts

from .conftest import DATA, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def duck(**tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return con


def documents():
    return pa.table({"doc_id": pa.array([r[0] for r in odd_rows()], pa.int64()), "text": pa.array([r[1] for r in odd_rows()], pa.string())})


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(r[c] for c in want.columns) for r in got.collect())
    assert rows == sorted(want.fetchall()) and rows


def test_substring_dedup_of_odd_texts(odd):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], digest(r["kept_text"])) for r in substring_dedup.remove_repeats(odd).collect()}
    assert got == {r[0]: r[1:] for r in duck(documents=documents()).sql(queries.SQL["op8_substring_dedup"]).fetchall()}


def test_substring_dedup_of_one_passage_in_many_documents(spark):
    passage = prose(7, 40)
    around = lambda i, side: [f"{side}{i}x{k}" for k in range(30)]
    rows = [(i, " ".join(around(i, "a") + passage + around(i, "b"))) for i in range(200)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["n_removed"] for r in got} == {40}


def test_near_dedup_of_odd_texts(odd):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(odd).collect()}
    assert got == set(duck(documents=documents()).sql(queries.SQL["op10_near_dedup"]).fetchall())


def test_near_dedup_of_a_large_group_with_chains(spark):
    """Copies with growing edits: ends of the chain are alike only through its middle."""
    base = prose(8, 120)
    rows = []
    for i in range(60):
        own = [*base]
        own[2 * (i // 2)] = f"w{i}"
        rows.append((i, " ".join(own[i // 10 :])))
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(duck(documents=table).sql(queries.SQL["op10_near_dedup"]).fetchall())


def test_quality_rules_statistics(odd):
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(odd, np.zeros(quality_rules.BUCKETS)).collect()}
    for i, text, *_ in odd_rows():
        ws, lines = words(text), (text or "").split("\n")
        at = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
        counts = Counter(at)
        covered = {k + j for k, w in enumerate(at) if counts[w] > 1 for j in range(8)}
        dup = sum(1 for k, x in enumerate(lines) if words(x) and x in set(lines[:k])) if len(lines) < 100 else 0
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))
        failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == (*want, failed, not failed), i


def test_quality_rules_score_is_the_mean_log_ratio(spark):
    docs = spark.createDataFrame([(1, "abcde"), (2, "ABC"), (3, "zzzzzzzz")], "doc_id long, text string")
    raw = quality_rules.ngram_counts(docs.select("text"))
    assert raw.sum() == 2 + 0 + 5
    ratio = quality_rules.log_ratio(quality_rules.ngram_counts(docs.where("doc_id = 1").select("text")), raw)
    got = {r["doc_id"]: r["score"] for r in quality_rules.apply_rules(docs, ratio).collect()}
    p, q = 2 / (2 + quality_rules.BUCKETS), (1 + 3.5) / (7 + 3.5 * quality_rules.BUCKETS)
    assert math.isclose(got[1], math.log(p / q), rel_tol=1e-9) and got[2] == 0 and got[3] < got[1]


def base_spans(text):
    text, out = text or "", []
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for k, pattern, ok in ((0, assign, lambda m: len(m[1]) >= 8), (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), (2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if ok(m)]
    return [(secret_scan.KINDS[k], s, e) for s, k, e in sorted(out)]


def test_secret_rules(odd):
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.find(odd, None).collect()}
    assert got == {r[0]: base_spans(r[1]) for r in odd_rows()}
    assert {k for spans in got.values() for k, *_ in spans} == {"assign", "access", "hex"}


def test_secret_query_keeps_the_rules_findings(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.QUERIES["op2_secret_scan"](spark, DATA).collect():
        want = [":".join(map(str, x)) for x in base_spans(texts[r["doc_id"]])]
        assert r["base_sha256"] == digest(",".join(want))
        assert set(want) <= set(r["spans"].split(","))


@pytest.mark.parametrize("length", [24, 40, 150])
def test_secret_network_learns_and_calibrates(spark, length):
    """Fresh secrets that no key word announces, short and longer than the network's width."""
    rng = np.random.default_rng(1)
    key = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), n))
    rows = [(i, f'{" ".join(prose(i, 8))} token = "{key(40)}" and file-{i:04d}/{prose(i, 1)[0]}.report-2020 end') for i in range(400)]
    network = secret_scan.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    keys = {i: key(length) for i in range(500, 600)}
    fresh = [(i, f'{" ".join(prose(i, 8))} {k} and file-{i:04d}/{prose(i, 1)[0]}.report-2020 end') for i, k in keys.items()]
    got = secret_scan.find(spark.createDataFrame(fresh, "doc_id long, text string"), network).collect()
    found = {(r["doc_id"], s["start"]) for r in got for s in r["spans"]}
    right = {(i, t.index(keys[i])) for i, t in fresh}
    assert len(found & right) >= 90 and len(found - right) <= 5


def test_secret_network_reads_all_of_a_long_candidate():
    chunk = next(textops.chunks(pa.array(["é " + "a1" * 300 + " end", "b2c3d4e5"])))
    x, first = secret_scan.encode(chunk, secret_scan.candidates(chunk))
    assert len(first) == 2 and first[1] == len(x) - 1
    inside = x[: first[1], secret_scan.BEFORE : secret_scan.BEFORE + secret_scan.WITHIN]
    assert inside.all() and len(inside) * (secret_scan.WITHIN - secret_scan.WIDTH + 1) >= 600 - secret_scan.WITHIN


def test_redaction_keeps_the_rest(wide):
    got = secret_scan.redact(wide, None)
    assert got.columns == wide.columns and got.count() == wide.count()
    texts = {r["text"] for r in got.collect()}
    assert not any(base_spans(t) for t in texts) and " ".join(prose(1, 90)) in texts


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def overlap(a, b):
    """Matches of the segment of the best score of all diagonals; of equal scores the last and shortest."""
    most = 0
    for d in range(-len(b) + 1, len(a)):
        pairs = [a[i] == b[i - d] for i in range(max(0, d), min(len(a), len(b) + d))]
        top, run, score, matches = 0, 0, 0, 0
        for same in pairs:
            score, run = (score + 1, run + 1) if same else (score - decontamination.PENALTY, run)
            if score <= 0:
                score = run = 0
            if score >= top:
                top, matches = score, run
        most = max(most, matches)
    return most


def test_overlaps_against_all_diagonals(spark):
    items = [(1, " ".join(prose(20, 30))), (2, "Short ITEM here"), (3, None), (4, ""), (5, " ".join(prose(21, 40)))]
    swapped = prose(20, 30)
    swapped[6] = swapped[20] = "other"
    texts = [None, "", " ".join(prose(22, 50) + prose(20, 30) + prose(23, 10)), " ".join(swapped), "a short, item; HERE too", "short item", " ".join(prose(20, 30)[:11]), " ".join(prose(24, 500)), " ".join(prose(21, 40)[5:30] + prose(21, 40)), " ".join(prose(25, 20_000) + prose(21, 40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k) for i, t in enumerate(texts) for k, x in items if tokens(x) and overlap(tokens(t), tokens(x)) >= decontamination.least_matches(len(tokens(x)))}
    for bound in (decontamination.SLICE, 20):
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_overlaps(docs, table, bound).collect()}
        assert got == want == {(2, 1), (3, 1), (4, 2), (8, 5), (9, 5)}
    kept = {r["doc_id"] for r in decontamination.drop_contaminated(docs, table, 20).collect()}
    # The item of three tokens is told of, but takes no document.
    assert kept == set(range(len(texts))) - {i for i, k in want if k != 2}


def test_every_overlap_that_counts_is_found(spark):
    """12 tokens verbatim, and copies of items of 8 to 30 tokens with random substitutions."""
    rng = np.random.default_rng(6)
    items = [(k, [f"t{k}x{j}" for j in range(n)]) for k, n in enumerate((8, 9, 11, 12, 13, 14, 20, 30, 40))]
    texts = [["x", "y", *items[8][1][20:32], "z"], ["x", *items[8][1][20:31], "z"], ["same"] * 3_000]
    for i in range(400):
        own = [t if rng.random() > 0.12 else f"new{i}" for t in items[i % len(items)][1]]
        texts.append(["before"] * (i % 3) + own + ["after"] * (i % 2))
    items.append((99, ["same"] * 2_000))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    want = {(i, k) for i, t in enumerate(texts) for k, x in items[:-1] if set(t) & set(x) and overlap(t, x) >= decontamination.least_matches(len(x))}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_overlaps(docs, table).collect()}
    assert got == want | {(2, 99)} and (0, 8) in got and (1, 8) not in got and 150 < len(got) < 400


def test_token_counts_against_a_plain_table(odd):
    vocabulary = token_counts.Vocabulary.of([x.encode() for x in ("▁", "▁ka", "tan", "▁lo", "ver", "a", "em", "or", "us", "▁mi", "dol", "pis", "é", "▁two", "words", "word")])
    flat = {}

    def score(piece):
        h = textops.span_hashes(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]))
        return flat.setdefault(piece, float(vocabulary.score(h)[0]))

    def count(word, memo={}):  # noqa: B006
        if word in memo:
            return memo[word]
        raw, best = ("▁" + word).encode(), [(0.0, 0)]
        for e in range(1, len(raw) + 1):
            found = [(best[s][0] + score(raw[s:e]), best[s][1] + 1) for s in range(max(0, e - 24), e)]
            top = max(f[0] for f in found)
            best.append(min((f for f in found if f[0] > top - 1e-9), key=lambda f: f[1]))
        memo[word] = best[-1][1]
        return memo[word]

    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(odd, vocabulary).collect()}
    assert got == {i: (len(words(t)), sum(map(count, words(t)))) for i, t, *_ in odd_rows()}


def targets(sizes):
    """Water-filling by repeated shares of what is left."""
    out, left, open_ = [0.0] * len(sizes), 1.5 * sum(sizes), [i for i, n in enumerate(sizes) if n]
    weight = lambda i: (5, 2, 1)[i % 3]
    while open_:
        share = left / sum(map(weight, open_))
        above = [i for i in open_ if share * weight(i) > 2 * sizes[i]]
        for i in above or open_:
            out[i] = 2.0 * sizes[i] if above else share * weight(i)
        if not above:
            break
        left -= sum(out[i] for i in above)
        open_ = [i for i in open_ if i not in above]
    return out


@pytest.mark.parametrize("sizes", [[], [0], [10], [1, 1000, 5, 0], [100, 100, 100, 100], [10**9, 3, 7], [5, 10**6, 10**6, 10**6, 2]])
def test_targets(sizes):
    assert np.allclose(mixing.targets(sizes), targets(sizes))


@pytest.mark.parametrize("sizes", [[1], [255], [256], [257, 4000, 70_000], [10**6, 300]])
def test_slots_are_dealt_whole(sizes):
    plan = mixing.Plan([str(i) for i in range(len(sizes))], sizes)
    drawn = [plan.draw(k) for k in range(plan.shards)]
    assert sum(int(d.sum()) for d in drawn) == sum(plan.slots) and all(d.sum() == mixing.SHARD for d in drawn[:-1])
    totals = dict(enumerate(sum(drawn).tolist()))
    closing = plan.closing(totals)
    for s, wanted in enumerate(plan.slots):
        own = sorted((k, n) for _, i, _, k, n in closing if i == s)
        assert min(totals[s], wanted) + sum(n for _, n in own) == wanted and all(k == totals[s] + sum(n for _, n in own[:j]) for j, (k, _) in enumerate(own))
    places = [(shard, at + j) for shard, _, at, _, n in closing for j in range(n)]
    assert len(set(places)) == len(places) and all(x >= plan.shards and at < mixing.SHARD for x, at in places)
    for s, n in enumerate(plan.blocks):
        for epoch in range(2):
            assert sorted(plan.permutation(s, np.arange(epoch * n, (epoch + 1) * n))) == list(range(n))


def test_mixing_takes_what_the_targets_say(spark, odd):
    placed, mixed, plan = mixing.mix(odd)
    rows = mixing.taken(placed, mixed, plan).collect()
    sizes = {r[0]: len(words(r[1])) for r in odd_rows()}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes and len(rows) == len(sizes)
    by = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]] += r["taken"]
    names = sorted({r[3] for r in odd_rows()}, key=lambda x: (x is None, x or ""))
    want = dict(zip(names, targets([sum(sizes[r[0]] for r in odd_rows() if r[3] == n) for n in names]), strict=True))
    assert all(abs(by[n] - want[n]) <= 1 for n in names)
    again = mixing.taken(*mixing.mix(odd.repartition(7))).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    slots = mixing.assemble(odd, placed, mixed, plan).collect()
    assert all(len(s["text"].split(" ")) == s["n_words"] for s in slots) and sum(s["n_words"] for s in slots) == sum(by.values())
    pool = Counter(w for r in odd_rows() for w in words(r[1]))
    assert all(n <= 2 * pool[w] for w, n in Counter(w for s in slots for w in s["text"].split(" ")).items())
    assert len({(s["shard"], s["slot"]) for s in slots}) == len(slots)


def test_chat_events_fold_in_order(spark):
    rows = [(1, 2, 0, "delta", "user", "lo"), (1, 1, 0, "delta", "user", "hel"), (1, 3, 1, "delta", "assistant", "bad"), (1, 4, 1, "regenerate", "assistant", "go"), (1, 5, 1, "delta", "assistant", "od"), (1, 6, 0, "edit", "user", "hi"), (2, 1, 0, None, None, None)]
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat_format.fold_events(spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")).collect()}
    assert got == {(1, 0): ("user", "hi"), (1, 1): ("assistant", "good"), (2, 0): ("", "")}


def test_chat_round_trip(spark):
    texts = ["", "plain", "</s>[INST] ok [/INST]", "<|end|><|role|>assistant<|text|>", "&amp;&lsqb;&lt;&", "é\n<\n[", None, "&" * 500 + "<|en" + "d|>"]
    rows = [(c, t, ("user", "assistant")[t % 2], x) for c in range(3) for t, x in enumerate(texts)]
    events = chat_format.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    got = chat_format.read_back(chat_format.format_chats(events)).collect()
    for r in got:
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, x or "") for c, _, role, x in rows if c == r["conv_id"]]
        assert "[INST]" not in r["formatted"] and "</s>" not in r["formatted"] and r["formatted"].count("<|end|>") == len(texts)
    assert len(got) == 3


def test_chat_main_path_is_native(spark):
    plan = queries.QUERIES["op9_chat_format"](spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapInArrow|MapPartitions", plan)


@pytest.mark.parametrize("conf", [9, 211])
def test_mixes_agree_whatever_the_settings(spark, odd, conf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", conf)
        got = sorted(map(repr, mixing.taken(*mixing.mix(odd)).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", 5)
        assert got == sorted(map(repr, mixing.taken(*mixing.mix(odd)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_token_counts_of_the_vocabulary_itself(spark):
    """Every distinct word of the table by the plain recurrence, and a very long word in linear time."""
    vocabulary = token_counts.load()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()} | {-1: "ab1é" * 20_000, -2: "x" * 256}
    count = {w: token_counts.count_alone((token_counts.MARK + w).encode(), vocabulary) for w in {w for t in texts.values() for w in words(t)}}
    got = token_counts.count_tokens(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), vocabulary).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: sum(count[w] for w in words(t)) for i, t in texts.items()}


def near_copies(n, edits):
    base = prose(8, 60)
    rng = np.random.default_rng(9)
    out = []
    for i in range(n):
        own = [*base]
        for at in rng.integers(0, 60, edits):
            own[at] = f"w{rng.integers(n)}"
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize(("edits", "bounds"), [(2, (4, 8, 40, 1)), (3, (4, 8, 40, 1)), (3, (4, 8, 1 << 22, 1 << 20))])
def test_near_dedup_by_blocks(spark, monkeypatch, edits, bounds):
    """Long lists, stars and components of many blocks, in groups around the threshold."""
    for name, value in zip(("LIST", "GROUP", "GROUP_SHINGLES", "CROSSED"), bounds, strict=True):
        monkeypatch.setattr(near_dedup, name, value)
    rows = near_copies(70, edits)
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(duck(documents=table).sql(queries.SQL["op10_near_dedup"]).fetchall())


def test_a_template_takes_no_sets_to_other_blocks(spark, monkeypatch):
    """Texts of 104 shared and 30 own words are linked with nothing; candidates by the shared ones, they are not verified."""
    for name, value in (("LIST", 16), ("GROUP", 32), ("CROSSED", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    shared, rng = prose(50, 104), np.random.default_rng(5)
    rows = [(i, " ".join([*shared, *(f"o{i}w{k}" for k in range(30))])) for i in range(90)] + [(100 + i, " ".join([*shared, *(f"o{i}w{k}" for k in range(30 - i % 3))])) for i in range(3)]
    docs = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string")
    nodes = near_dedup.classes(jobs.stored(near_dedup.signatures(docs)))
    found = near_dedup.components(near_dedup.candidate_edges(docs, nodes))
    assert found.groupBy("component").count().agg({"count": "max"}).first()[0] > 32
    sets = jobs.stored(near_dedup.sets_of(docs, found.select("node").join(nodes, "node").select("node", "id", "n", "d1", "d2")))
    assert near_dedup.refined(sets, found, nodes).count() == 4
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {**{i: i for i in range(90)}, **{100 + i: i for i in range(3)}}


def test_one_row_of_each_component_stays(spark):
    """Whatever their ids; rows of empty sets all stay."""
    a, b = " ".join(prose(30, 40)), " ".join(prose(31, 40))
    kept = lambda rows: sorted(map(tuple, near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert kept([(1, a), (None, a), (None, b)]) == [(1, a), (None, b)]
    assert kept([(5, a), (5, b)]) == sorted([(5, a), (5, b)])
    assert kept([(5, a), (5, a), (4, a + " end"), (5, None), (5, None), (None, "")]) == sorted([(4, a + " end"), (5, None), (5, None), (None, "")], key=repr)
