"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Small trees are grown on the statistics of a bounded labelled sample; every path from a
root to a node is a rule. A logistic model with an L1 penalty weighs the rules, most of
which get weight 0, and the rest become one Spark column expression. Scoring thus is a
projection over the statistics and runs on every document.

Defined results: a null or empty text has statistics 0 and is scored by the same rules;
equal rows get equal results; extra columns are ignored; without labelled rows the score
is 0.5; a null id is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm import jobs, textops

LABELLED_ROWS = 8_000
TREES, DEPTH, LEAST, CUTS = 24, 3, 20, 24
#: Share of the largest penalty at which all weights are 0.
PENALTY = 0.01
THRESHOLD = 0.3

STATISTICS = ("n_words", "mean_word", "upper", "symbols", "exclamations", "digits", "other_marks", "distinct_words", "repeated_next", "top_word", "repeat_windows", "dup_lines", "words_per_line", "bars")


def _bytes(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


UPPER, DIGITS = _bytes(bytes(range(0x41, 0x5B))), _bytes(b"0123456789")
SYMBOLS, MARKS = _bytes(b"#*$%&<>"), _bytes(b"\"'()+-/=@[\\]^_`{}~:;?")


def statistics(chunk: textops.Chunk) -> np.ndarray:
    """A row of numbers for each text, in the order of STATISTICS."""
    data, words, rows = chunk.data, chunk.words(), chunk.rows
    size = np.maximum(np.diff(chunk.offsets), 1)
    n = np.maximum(words.counts, 1)
    # Capitals outside ASCII of the Latin-1 letters: C3 80 to C3 9E.
    wide = np.zeros(len(data), bool)
    wide[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    h = textops.span_hashes(data, words.starts, words.ends)
    earlier, _ = textops.same_before(words.row, h)
    order = np.lexsort((h, words.row))
    r, v = words.row[order], h[order]
    edge = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])))) if len(r) else np.empty(0, int)
    top = np.zeros(rows)
    np.maximum.at(top, r[edge], np.diff(np.append(edge, len(r))))
    nxt = np.flatnonzero((h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1]))
    at = words.windows(8)
    again = textops.same_before(words.row[at], textops.window_hashes(h, 8)[at])[1] if len(at) else np.empty(0, bool)
    lines = chunk.spans(data != 0x0A)
    same_lines = textops.same_before(lines.row, textops.span_hashes(data, lines.starts, lines.ends))[0]
    count = lambda x: np.bincount(x, minlength=rows)
    return np.column_stack([
        words.counts,
        np.bincount(words.row, words.ends - words.starts, rows) / n,
        (chunk.per_row(UPPER[data]) + chunk.per_row(wide)) / size,
        chunk.per_row(SYMBOLS[data]) / size,
        chunk.per_row(data == 0x21) / size,
        chunk.per_row(DIGITS[data]) / size,
        chunk.per_row(MARKS[data]) / size,
        1 - count(words.row[earlier]) / n,
        count(words.row[nxt]) / n,
        top / n,
        count(words.row[at[again]]) / n,
        count(lines.row[same_lines]) / np.maximum(lines.counts, 1),
        words.counts / np.maximum(lines.counts, 1),
        chunk.per_row(data == 0x7C) / n,
    ]).astype(np.float64)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a column ``__s``, an array of the statistics of their texts."""
    schema = docs.schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textops.chunks(batch.column(at)):
                s = statistics(chunk)
                rows = batch.slice(chunk.first_row, chunk.rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*rows.schema.names, "__s"])

    kind = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    return docs.mapInArrow(run, f"{kind}, __s array<double>")


Condition = tuple[int, bool, float]  # statistic, whether above, bound


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, s: Column | str = "__s") -> Column:
        """The probability of label 1 as one column expression."""
        s = F.col(s) if isinstance(s, str) else s
        holds = lambda c: s[c[0]] > F.lit(c[2]) if c[1] else s[c[0]] <= F.lit(c[2])
        terms = [F.when(reduce(lambda a, b: a & b, map(holds, rule)), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))


def _grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, depth: int, path: tuple[Condition, ...], out: list) -> None:
    """Splits by the gain in squared residuals; adds the paths to all nodes."""
    best = None
    total, mass = residual.sum(), weight.sum()
    if depth and len(x) >= 2 * LEAST:
        for j in range(x.shape[1]):
            cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1]))
            bins = np.searchsorted(cuts, x[:, j])  # a value is above cuts[b - 1]
            n, g, w = (np.bincount(bins, v, len(cuts) + 1).cumsum()[:-1] for v in (np.ones(len(x)), residual, weight))
            ok = (n >= LEAST) & (n <= len(x) - LEAST)
            gain = np.where(ok, g**2 / (w + 1) + (total - g) ** 2 / (mass - w + 1), -1)
            k = int(gain.argmax())
            if ok[k] and (best is None or gain[k] > best[0] + 1e-12):
                best = gain[k], j, float(cuts[k])
    if best is None or best[0] <= total**2 / (mass + 1) + 1e-9:
        return
    _, j, cut = best
    for above in (False, True):
        part = (x[:, j] > cut) == above
        rule = (*path, (j, above, cut))
        out.append((rule, residual[part].sum() / (weight[part].sum() + 1)))
        _grow(x[part], residual[part], weight[part], depth - 1, rule, out)


def satisfied(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > c) == above for j, above, c in rule])


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[tuple[Condition, ...]]:
    """Paths of boosted trees, each grown on half of the sample; without repetitions."""
    rng = np.random.default_rng(seed)
    z, found = np.zeros(len(y)), {}
    for _ in range(TREES):
        own = np.sort(rng.permutation(len(y))[: max(len(y) // 2, min(len(y), 4 * LEAST))])
        p = 1 / (1 + np.exp(-z))
        out: list = []
        _grow(x[own], (y - p)[own], (p * (1 - p))[own], DEPTH, (), out)
        deepest = {rule: v for rule, v in out if not any(r[: len(rule)] == rule and len(r) > len(rule) for r, _ in out)}
        for rule, v in deepest.items():
            z += 0.3 * v * satisfied(x, rule)
        found |= {tuple(sorted(rule)): None for rule, _ in out}
    unique: dict[bytes, tuple[Condition, ...]] = {}
    for rule in sorted(found, key=lambda r: (len(r), r)):  # of rules that hold for the same rows, the shortest stays
        unique.setdefault(np.packbits(satisfied(x, rule)).tobytes(), rule)
    return list(unique.values())


def fit_lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic weights by accelerated proximal gradients."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    b, w = float(np.log(mean / (1 - mean))), np.zeros(r.shape[1])
    if not r.shape[1]:
        return b, w
    least = penalty * np.abs(r.T @ (y - mean)).max() / len(y)
    rate = 4 * len(y) / (np.linalg.norm(np.column_stack([np.ones(len(y)), r]), 2) ** 2)
    vb, v, t = b, w.copy(), 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(vb + r @ v))) - y
        nb, nw = vb - rate * g.mean(), v - rate * (r.T @ g) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * least, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, v = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return float(b), w


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model(0.0, ())
    rules = extract_rules(x, y)
    if not rules:
        return Model(fit_lasso(np.zeros((len(y), 0)), y)[0], ())
    b, w = fit_lasso(np.column_stack([satisfied(x, rule) for rule in rules]).astype(float), y)
    return Model(b, tuple((rule, float(v)) for rule, v in zip(rules, w, strict=True) if abs(v) > 1e-6))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = LABELLED_ROWS) -> Model:
    """At most ``bound`` labelled rows' statistics reach the driver."""
    rows = with_statistics(jobs.with_labels(docs, jobs.labelled(labels, label, bound)).dropDuplicates(["doc_id"]))
    got = rows.select("doc_id", "__s", "y").toPandas().sort_values("doc_id")
    return fit_arrays(np.array(got["__s"].tolist(), float).reshape(-1, len(STATISTICS)), got["y"].to_numpy(float))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with their columns, whose score reaches the threshold."""
    rows = with_statistics(jobs.numbered(docs), f"c{docs.columns.index('text')}")
    return rows.where(model.score() >= threshold).drop("__s").toDF(*docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    jobs.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_statistics(docs).select("doc_id", F.coalesce(jobs.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
