"""The secret network: its thresholds, its labelled findings and its candidates."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import jobs, secret_scan, textops

from .conftest import prose


def test_thresholds_keep_the_recall():
    """Also where the quantile of the held-out positives is low."""
    rng = np.random.default_rng(4)
    x = rng.integers(1, 27, (400, secret_scan.LENGTH)).astype(np.uint8)
    y = (rng.random(400) < 0.5).astype(float)  # nothing to learn: probabilities near the rate
    network = secret_scan.Network.new()
    network.calibrate(x, y)
    assert network.reached(x)[y == 1].mean() >= secret_scan.RECALL and max(network.thresholds) < 0.9


def key(seed, n=40):
    rng = np.random.default_rng(seed)
    return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), n))


def test_a_table_without_findings_gets_a_network(spark):
    """And it finds a secret that no rule does in another one."""
    network = secret_scan.fit(spark.createDataFrame([(0, " ".join(prose(3, 20)))], "doc_id long, text string"))
    docs = spark.createDataFrame([(1, f"{' '.join(prose(1, 20))} {key(1)} {' '.join(prose(2, 20))}")], "doc_id long, text string")
    text = docs.first()["text"]
    spans = secret_scan.find(docs, network).first()["spans"]
    assert [("model", text.index(key(1)), text.index(key(1)) + 40)] == [tuple(s) for s in spans]


def encoded(texts):
    """The encoded candidate of each text, which has one."""
    out = []
    for chunk in textops.chunks(pa.array(texts)):
        found = secret_scan.candidates(chunk)
        assert len(found.starts) == chunk.rows
        out += [r.tobytes() for r in secret_scan.encode(chunk, found)[0]]
    return out


@pytest.fixture(scope="module")
def harmless(spark):
    """5,000 documents of one candidate each, by the hash of that."""
    texts = [f"see {key(i, 5)}-{key(i + 9_000, 6)} here" for i in range(5_000)]
    rows = [(i, t, bytearray(x)) for i, (t, x) in enumerate(zip(texts, encoded(texts), strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, x binary").dropDuplicates(["x"]).orderBy(F.xxhash64("x"), "x").cache()


def same(a, b):
    return all(np.array_equal(getattr(a, n), getattr(b, n)) for n in ("kernel", "bias", "dense", "shift", "thresholds"))


def test_every_candidate_tells(spark, harmless):
    """Those after the 4,000 of the least hashes, too."""
    assert harmless.count() > 4_500
    assert not same(secret_scan.fit(harmless), secret_scan.fit(harmless.limit(4_000)))


def test_how_the_table_is_split_is_no_matter(spark, harmless, monkeypatch):
    monkeypatch.setattr(secret_scan, "SHARD_ROWS", 1_500)
    monkeypatch.setattr(secret_scan, "STEPS", 30)
    assert same(secret_scan.fit(harmless.repartition(1)), secret_scan.fit(harmless.repartition(5).union(harmless)))


def test_a_shard_keeps_all_of_its_candidates():
    rng = np.random.default_rng(5)
    x = rng.integers(1, 40, (3_000, secret_scan.LENGTH)).astype(np.uint8)
    y, h = (rng.random(3_000) < 0.1).astype(np.int32), rng.integers(-(2**63), 2**63 - 1, 3_000)
    out = secret_scan.pack(pa.table({"shard": np.zeros(3_000, np.int64), "hash": h, "x": pa.array([r.tobytes() for r in x], pa.binary()), "y": y})).to_pylist()[0]
    got_x = np.frombuffer(out["x"] + out["x_held"], np.uint8).reshape(-1, secret_scan.LENGTH)
    got_y = np.frombuffer(out["y"] + out["y_held"], np.uint8)
    tail = lambda x, y: sorted((r[secret_scan.BEFORE :].tobytes(), int(k)) for r, k in zip(x, y, strict=True))
    assert tail(got_x, got_y) == tail(x, y)
    assert 600 < len(out["y_held"]) < 900
    moved = {r[: secret_scan.BEFORE].tobytes() for r in got_x} - {r[: secret_scan.BEFORE].tobytes() for r in x[y == 0]}
    assert len(moved) < (y == 1).sum()  # half of the secrets have another's context


def test_calibration_over_a_table_is_that_over_arrays(spark):
    jobs.prepare(spark)
    rng = np.random.default_rng(6)
    x = rng.integers(1, 27, (900, secret_scan.LENGTH)).astype(np.uint8)
    x[::3, 2:8] = secret_scan.CLASS[list(b"secret")]
    y = (rng.random(900) < 0.3).astype(int)
    near, far = secret_scan.Network.new(), secret_scan.Network.new()
    near.calibrate(x, y.astype(float))
    rows = zip(far.logits(x).tolist(), y.tolist(), secret_scan.announced(x).tolist(), strict=True)
    far.calibrate_on(spark.createDataFrame(list(rows), "z double, y int, announced boolean").repartition(4))
    assert secret_scan.announced(x).sum() >= 300
    assert np.allclose([near.slope, near.offset, *near.thresholds, near.precision], [far.slope, far.offset, *far.thresholds, far.precision], atol=1e-6)
    assert np.array_equal(near.reached(x), far.reached(x))


def test_gradients_against_differences():
    rng = np.random.default_rng(7)
    x = (rng.integers(1, secret_scan.CLASSES, (50, secret_scan.LENGTH)) | rng.choice([0, 64], (50, secret_scan.LENGTH))).astype(np.uint8)
    y, weight, network = rng.integers(0, 2, 50), rng.random(50), secret_scan.Network.new()

    def loss(flat):
        z = network.with_weights(flat).logits(x)
        return (weight * (np.logaddexp(0, z) - y * z)).sum()

    grads = network.gradients(x, y, weight)
    flat, grad = network.flat(), np.concatenate([np.ravel(grads[n]) for n in secret_scan.WEIGHTS])
    for i in [*np.argsort(-np.abs(grad))[:20], len(flat) - 1]:
        e = np.where(np.arange(len(flat)) == i, 1e-3, 0)
        assert (loss(flat + e) - loss(flat - e)) / 2e-3 == pytest.approx(grad[i], rel=0.02)
