"""Empty tables, nulls in any column, repeated rows and clashing columns; and accuracy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloakwork.llm import decontamination, jobs, mixing, near_dedup, quality_classifier, quality_rules, queries, secret_scan, substring_dedup, textops, token_counts, toxicity

from .conftest import DATA, prose


def operators(docs, labels, items):
    vocabulary = token_counts.Vocabulary.of([b"a"])
    return {
        "1": lambda: mixing.taken(*mixing.mix(docs)),
        "1 assembled": lambda: mixing.assemble(docs, *mixing.mix(docs)),
        "2": lambda: secret_scan.find(docs, secret_scan.fit(docs)),
        "2 redacted": lambda: secret_scan.redact(docs, secret_scan.fit(docs)),
        "3": lambda: quality_rules.apply_rules(docs, quality_rules.fit(docs, labels)),
        "4": lambda: toxicity.score(docs, toxicity.fit(docs, labels)),
        "5": lambda: quality_classifier.keep_good(docs, quality_classifier.fit(docs, labels), 0.0),
        "6": lambda: decontamination.find_overlaps(docs, items),
        "6 dropped": lambda: decontamination.drop_contaminated(docs, items),
        "7": lambda: token_counts.count_tokens(docs, vocabulary),
        "8": lambda: substring_dedup.remove_repeats(docs),
        "10": lambda: near_dedup.near_duplicates(docs),
        "10 kept": lambda: near_dedup.keep_one(docs),
    }


NAMES = [*operators(None, None, None)]
LABELS, ITEMS = "doc_id long, quality int, toxic int", "item_id long, text string"


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, odd, name):
    jobs.prepare(spark)
    labels, items = spark.createDataFrame([], LABELS), spark.createDataFrame([], ITEMS)
    assert operators(odd.where("false"), labels, items)[name]().count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_repeated_rows_nulls_and_clashing_columns(spark, wide, name):
    jobs.prepare(spark)
    labels = spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 1, 0), (2, 0, 1), (8, 1, 1), (9, 0, 0)], LABELS)
    items = spark.createDataFrame([(None, "two words"), (1, None), (2, ""), (2, "nothing like it"), (None, " ".join(prose(2, 45)))], ITEMS)
    rows = operators(wide, labels, items)[name]()
    got = rows.collect()
    if name in ("5", "2 redacted", "6 dropped", "10 kept"):
        assert rows.columns == wide.columns
        # Columns that the operator doesn't touch keep their values.
        assert all([r[c] for c in wide.columns[5:]] == list(range(len(wide.columns) - 5)) for r in got)
    if name in ("1", "2", "2 redacted", "3", "4", "5", "7", "8", "10"):
        assert len(got) == wide.count()
    if name == "10 kept":
        ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
        full = [i for i in ids if i > 3]
        assert len(full) == len(set(full)) and {4, 5, 8} <= set(full) and not {6, 9, 10} & set(full)
        # Rows of empty texts are linked with nothing, whatever their ids.
        assert sorted(i for i in ids if i <= 3) == [1, 1, 2, 2, 3, 3]
    if name == "6 dropped":
        assert not any(r["doc_id"] in (12, 13, 14) for r in got) and {4, 5, 6, 7} <= {r["doc_id"] for r in got}


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    values, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)), order


@pytest.mark.parametrize(("name", "label", "least"), [("op4_toxicity", "toxic", 0.8), ("op5_quality_classifier", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    data = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet").where(F.col(label).isNotNull()).select("doc_id", label)
    rows = queries.QUERIES[name](spark, data)
    assert rows.where(F.col("score").isNull() | ~F.col("score").between(0, 1)).isEmpty()
    held = rows.where("held_out").join(labels, "doc_id").toPandas()
    assert auc(held["score"].to_numpy(), held[label].to_numpy())[0] >= least


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(jobs.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    assert quality_classifier.fit(docs, labels) == quality_classifier.fit(docs, flipped)


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(2)
    dense = rng.random((300, 40)) * (rng.random((300, 40)) < 0.2)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    row, term = np.nonzero(dense)
    telling = rng.random(40) * 9
    index = toxicity.Index.build(np.arange(300), rng.integers(0, 2, 300), np.searchsorted(row, np.arange(301)), term, dense[row, term], telling)
    for i, q in enumerate(dense[:60]):
        t = np.flatnonzero(q)
        at, sims, told = index.nearest(t, q[t], 25)
        assert np.allclose(sims, np.sort(dense @ q)[::-1][: len(sims)], atol=1e-6) and len(at) == min(25, int((dense @ q > 0).sum()))
        assert np.allclose(told, [(dense[e] * q * telling).sum() for e in index.ids[at]], rtol=1e-5)
        assert i not in index.ids[index.nearest(t, q[t], 25, without=i)[0]]


def test_pruned_neighbours_on_real_texts_are_the_dense_ones(spark):
    """All blocks against all examples' vectors, and fewer weights read than there are."""
    jobs.prepare(spark)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    index, read = model.index, []
    examples = {r["doc_id"]: r["text"] for r in docs.where(F.col("doc_id").isin(index.ids.tolist())).collect()}
    matrix = np.zeros((len(index.ids), len(model.terms)), np.float32)
    unit = lambda text: toxicity.vectors(next(iter(textops.chunks(pa.array([text or ""])))), model.terms, model.idf)
    for e, doc_id in enumerate(index.ids.tolist()):
        _, term, weight = unit(examples[doc_id])
        matrix[e, term] = weight
    for r in docs.orderBy("doc_id").limit(150).collect():
        _, term, weight = unit(r["text"])
        at, sims, _ = index.nearest(term, weight, 25, read=read)
        want = matrix[:, term].astype(float) @ weight
        order = np.lexsort((index.ids, -np.round(want, 12)))[:25]
        assert np.allclose(sims, want[order][: len(sims)], atol=1e-9) and set(index.ids[at]) == {i for i, w in zip(index.ids[order], want[order], strict=True) if w > 1e-12}
    assert 0 < sum(a for a, _ in read) < 0.95 * sum(b for _, b in read)


def test_idf_votes_and_calibration_by_hand(spark):
    jobs.prepare(spark)
    texts = ["alpha beta", "alpha gamma", "beta beta delta", "delta", None, "gamma alpha"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, int(i % 6 < 2)) for i in range(24)], LABELS)
    model = toxicity.fit(docs, labels)
    terms = {w: int(np.searchsorted(model.terms, h)) for w in ("alpha", "beta", "gamma", "delta") for h in toxicity.terms_of(next(iter(textops.chunks(pa.array([w])))))[1]}
    df = {"alpha": 12, "beta": 8, "gamma": 8, "delta": 8}
    assert all(np.isclose(model.idf[k], np.log(25 / (1 + df[w])) + 1e-6) for w, k in terms.items())
    _, term, weight = toxicity.vectors(next(iter(textops.chunks(pa.array(["alpha beta"])))), model.terms, model.idf)
    vote, at, sims = model.vote(term, weight)
    pull = model.index.nearest(term, weight, toxicity.NEIGHBOURS)[2] + toxicity.LEAST_PULL
    assert np.isclose(vote, ((pull * model.index.labels[at]).sum() + model.base) / (pull.sum() + 1)) and np.isclose(sims[0], 1, atol=1e-6)
    assert np.isclose(model.calibrated(vote), 1 / (1 + np.exp(-(model.slope * np.log(vote / (1 - vote)) + model.shift))))
    for x, y in ((rng := np.random.default_rng(4)).normal(size=200), None), (np.repeat([-30.0, 30.0], 50), np.repeat([0.0, 1.0], 50)):
        y = (x + rng.normal(size=len(x)) > 0.3).astype(float) if y is None else y
        with np.errstate(all="raise", under="ignore"):
            a, b = toxicity._logistic(x, y)
        loss = lambda a, b: (np.logaddexp(0, a * x + b) - y * (a * x + b)).sum() + (a - 1) ** 2 / 2 + 0.005 * b * b  # noqa: B023, E731
        assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.01, 0.01) for db in (-0.01, 0.01))


def test_pipeline_stages(spark):
    """Each stage, over all that the one before it kept, against its operator's own answer."""
    docs = source = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
    scores = {r["doc_id"]: r["score"] for r in queries.QUERIES["op5_quality_classifier"](spark, DATA).collect()}
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "mix"]
    for name, stage in corpus_pipeline.STAGES:
        out = jobs.stored(stage(spark, docs, DATA))
        if name == "quality":
            assert ids(out) == {i for i, s in scores.items() if s >= quality_classifier.THRESHOLD}
        if name == "near_duplicates":
            assert ids(out) == ids(near_dedup.near_duplicates(docs).where("kept")) and out.count() < docs.count()
        if name == "decontaminate":
            assert ids(docs) - ids(out) == ids(decontamination.find_overlaps(docs, items))
        if name == "secrets":
            assert ids(out) == ids(docs)
            assert out.where(F.col("n_chars") != F.length("text")).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").where("text <> t").isEmpty()
        if name == "mix":
            assert sum(r["n_words"] for r in out.collect()) == sum(round(t) for t in mixing.mix(docs)[2].targets)
        else:
            assert out.dtypes == source.dtypes
        docs = out


def test_toxicity_reads_every_text_with_a_term_of_an_example(spark):
    """Terms that are in one example only, or in both labels alike, give neighbours too."""
    words = [f"rare{i}" for i in range(40)]
    docs = spark.createDataFrame([*((i, f"common {w}") for i, w in enumerate(words)), *((100 + i, f"{w} beside") for i, w in enumerate(words)), (200, "nothing alike"), (201, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, None, int(i % 4 == 0)) for i in range(40)], LABELS))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    examples = set(model.index.ids.tolist())
    assert examples and all([e["doc_id"] for e in got[100 + i]["evidence"]][:1] == [i] for i in examples)
    assert not got[200]["evidence"] and not got[201]["evidence"]


def test_token_counts_use_pieces_of_any_length(spark):
    vocabulary = token_counts.Vocabulary.of(["▁".encode(), "▁самостоятельность".encode(), b"x" * 60])
    rows = spark.createDataFrame([(1, "самостоятельность"), (2, "x" * 60), (3, "x" * 59)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(rows, vocabulary).collect()} == {1: 1, 2: 2, 3: 60}
