"""Quality rules: repetition statistics and a hashed n-gram likelihood ratio.

``score`` is the mean, over the byte n-grams of a text, of
log(p_target / p_raw), where both are multinomials over ``buckets`` hash buckets: the
target's of trusted documents, the raw one's of all documents. The smoothing counts of
the two are in the ratio of their totals, so an n-gram that is rare in both says nothing.
Length-normalised scores under ``threshold`` fail. The raw counts cover every document;
the trusted set is at most ``bound`` rows labelled good.

Defined results: a null or empty text has no words, score 0 and fails the base rule;
equal rows get equal results; extra columns are ignored; without trusted documents all
scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm import jobs, textops

NGRAM, BUCKETS, SLICES = 4, 1 << 16, 16
TRUSTED_ROWS = 20_000
THRESHOLD = -0.4
MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 30
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def ngram_buckets(chunk: textops.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all byte n-grams within rows of the lower-cased bytes, and the
    number of n-grams before each row."""
    data = textops.LOWER[chunk.data].astype(np.uint32)
    n = len(data) - NGRAM + 1
    counts = np.maximum(np.diff(chunk.offsets) - NGRAM + 1, 0)
    first = np.concatenate(([0], np.cumsum(counts)))
    if n <= 0:
        return np.empty(0, np.int64), first
    h = np.zeros(n, np.uint32)
    for k in range(NGRAM):
        h = h * np.uint32(0x01000193) + data[k : n + k]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(16)
    inside = np.ones(len(data), bool)
    for k in range(1, NGRAM):
        at = chunk.offsets[1:] - k
        inside[at[(at >= chunk.offsets[:-1])]] = False
    return h[inside[:n]].astype(np.int64), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's n-grams, a row for each slice of buckets."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for chunk in textops.chunks(batch.column(0)):
            total += np.bincount(ngram_buckets(chunk)[0], minlength=BUCKETS)
    yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "counts": [x.tobytes() for x in np.split(total, SLICES)]})


def _sum(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS // SLICES, np.int64)
    for batch in batches:
        for x in batch.column("counts"):
            total += np.frombuffer(x.as_py(), np.int64)
    yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": [total.tobytes()]})


def ngram_counts(texts: DataFrame) -> np.ndarray:
    """The multinomial's counts over all rows; 16 rows, half a megabyte, reach the driver."""
    kind = "slice int, counts binary"
    rows = texts.mapInArrow(_count, kind).groupBy("slice").applyInArrow(_sum, kind).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r["slice"] * (BUCKETS // SLICES) : (r["slice"] + 1) * (BUCKETS // SLICES)] = np.frombuffer(r["counts"], np.int64)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    share = raw.sum() / target.sum()
    p, q = target + 1.0, raw + share
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRUSTED_ROWS) -> np.ndarray:
    trusted = jobs.labelled(labels, "quality", bound).where("y = 1")
    target = ngram_counts(jobs.with_labels(docs, trusted).select("text"))
    return log_ratio(target, ngram_counts(docs.select("text")))


def base_statistics(chunk: textops.Chunk) -> dict[str, np.ndarray]:
    """Exact repetition and symbol counts of each row."""
    data, words = chunk.data, chunk.words()
    points = np.concatenate(([0], np.cumsum(textops.code_points(data))))
    rows = chunk.rows
    out = {"n_words": words.counts}
    out["word_chars"] = np.bincount(words.row, points[words.ends] - points[words.starts], rows).astype(np.int64)
    out["n_symbols"] = chunk.per_row(SYMBOLS[data])
    lines = chunk.spans(data != 0x0A)
    full = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    s, e, r = lines.starts[full], lines.ends[full], lines.row[full]
    out["n_dup_lines"] = np.bincount(r[textops.same_before(r, textops.span_hashes(data, s, e))[0]], minlength=rows)
    at = words.windows(WINDOW)
    hashes = textops.window_hashes(textops.span_hashes(data, words.starts, words.ends), WINDOW)
    again = textops.same_before(words.row[at], hashes[at] if len(at) else np.empty(0, np.uint64))[1]
    repeated = textops.covered(len(words.starts), at[again], WINDOW)
    out["n_repeat_words"] = np.bincount(words.row[repeated], minlength=rows)
    return out


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def apply_rules(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document, with the statistics, the score and the verdict."""
    table = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textops.chunks(batch.column(1)):
                out = base_statistics(chunk)
                buckets, first = ngram_buckets(chunk)
                sums = np.concatenate(([0.0], np.cumsum(table.value[buckets])))
                score = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)
                failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED * out["n_words"])
                ids = batch.column(0).slice(chunk.first_row, chunk.rows)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in out.values()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op3(spark, sf_dir: str) -> DataFrame:
    jobs.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_rules(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
