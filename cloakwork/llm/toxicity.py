"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine.

A bounded sample of labelled rows gives the examples, and all their terms the vocabulary.
Inverse document frequencies are counted over all documents. The examples stand in an order
that puts like ones together, cut into blocks, and an inverted index over them knows the largest weight of each
long list in each block. A query reads its short lists; these sums and its block's maxima bound every
example's cosine. The examples of the largest bounds are scored first, then those whose bounds reach the k-th
cosine; in the long lists the others are skipped, and the neighbours are exact. A neighbour votes with its cosine, of which each
shared term's part counts the more, the more the term's counts differ between the labels (the chi-square
statistic). Votes are calibrated by a logistic curve fitted to leave-one-out votes of the examples.

Defined results: a text without any term of an example (null and empty ones too) gets the
smoothed rate of such examples; ties in the cosine go to the smaller example id; equal
rows get equal results; extra columns are ignored; without labelled rows every score is
0.5; a null id is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm import jobs, textops

LABELLED_ROWS, STEM = 8_000, 6
NEIGHBOURS = 25
#: Examples of a block of the index; at most so many long lists, of at least one example in LONG.
BLOCK, COLUMNS, LONG = 32, 512, 64
#: Queries whose long lists are read together.
QUERIES = 64
#: More than what rounding can take from a bound, and more than the error of a cosine of single precision.
SLACK, SINGLE = 1e-6, 1e-4
THRESHOLD, LEAST_PULL, PRIOR_MASS = 0.5, 1e-3, 1.0


def terms_of(chunk: textops.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct lower-cased alphanumeric terms of each row: the
    words, and the first STEM bytes of longer words."""
    words = chunk.words(textops.NON_ALNUM)
    data = textops.LOWER[chunk.data]
    long = words.ends - words.starts > STEM
    stems = textops.mix(textops.span_hashes(data, words.starts[long], words.starts[long] + STEM), 2)
    h = np.concatenate([textops.span_hashes(data, words.starts, words.ends), stems]).view(np.int64)
    row = np.concatenate([words.row, words.row[long]])
    order = np.lexsort((h, row))
    r, v = row[order], h[order]
    if not len(r):
        return r, v, r
    edge = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1]))))
    return r[edge], v[edge], np.diff(np.append(edge, len(r)))


def vocabulary(examples: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the examples, in ascending order, and how much each tells of the labels: the chi-square
    statistic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for chunk in textops.chunks(batch.column(0)):
                row, term, _ = terms_of(chunk)
                yield pa.RecordBatch.from_pydict({"term": term, "y": pa.array(y[row + chunk.first_row], pa.int32())})

    totals = {r["y"]: r["n"] for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    one, zero = totals.get(1, 0), sum(v for k, v in totals.items() if k != 1)
    counts = examples.select("text", "y").mapInArrow(run, "term long, y int").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("a"), F.count("*").alias("n")).toArrow()
    terms, a, n = (counts.column(c).to_numpy() for c in ("term", "a", "n"))
    order = np.argsort(terms)
    terms, a, n, total = terms[order], a[order].astype(float), n[order].astype(float), float(one + zero)
    if not one or not zero:
        return terms, np.ones(len(terms))  # One label alone: every term tells alike.
    gap = a * zero - (n - a) * one
    return terms, gap * gap * total / (n * (total - n + 1) * one * zero)


def document_counts(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many documents there are. A task
    gives a row for each term that it met."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        total = np.zeros(len(own) + 2, np.int64)  # terms, others, documents
        for batch in batches:
            total[-1] += batch.num_rows
            for chunk in textops.chunks(batch.column(0)):
                total[:-1] += np.bincount(lookup(own, terms_of(chunk)[1]), minlength=len(own) + 1)
        met = np.flatnonzero(total)
        for at in range(0, len(met), 100_000):
            k = met[at : at + 100_000]
            yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "n": total[k]})

    rows = docs.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    held.destroy()
    out = np.zeros(len(terms) + 2, np.int64)
    out[rows.column("k").to_numpy()] = rows.column("n").to_numpy()
    return out[:-2], int(out[-1])


def lookup(terms: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Positions in the sorted terms; len(terms) for others."""
    if not len(terms):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
    return np.where(terms[at] == found, at, len(terms))


def vectors(chunk: textops.Chunk, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, term, weight): unit TF-IDF vectors of the rows over the vocabulary."""
    row, term, count = terms_of(chunk)
    at = lookup(terms, term)
    own = at < len(terms)
    row, at = row[own], at[own]
    w = (1 + np.log(count[own])) * idf[at]
    norm = np.sqrt(np.bincount(row, w * w, chunk.rows))
    return np.searchsorted(row, np.arange(chunk.rows + 1)), at, w / norm[row]


def ranges(starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions in all the ranges, and for each its range's value."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n), np.repeat(value, n)


def likeness(n: int, first: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int) -> np.ndarray:
    """An order of the rows that puts rows of like terms together: by the second leading direction of their
    vectors, found by a few steps of power iteration, within eighths of the first one."""
    row = np.repeat(np.arange(n), np.diff(first))
    found = []
    for seed in (0, 1):
        x = np.random.default_rng(seed).normal(size=n)
        for _ in range(12):
            x = np.bincount(row, weight * np.bincount(term, weight * x[row], n_terms)[term], n)
            for other in found:
                x -= other * (other @ x)
            x /= np.linalg.norm(x) or 1.0
        found.append(x)
    eighth = np.argsort(np.argsort(found[0], kind="stable"), kind="stable") * 8 // max(n, 1)
    return np.lexsort((found[1], eighth))


@dataclass
class Index:
    """Inverted index over examples. Short lists are postings; long ones hold a weight for every example, by blocks of
    BLOCK, with each block's maximum. Weights are of single precision, sums of double."""

    ids: np.ndarray  # of the examples
    labels: np.ndarray
    telling: np.ndarray  # by term
    postings: np.ndarray  # examples by term
    weights: np.ndarray
    first: np.ndarray  # where each term's short list starts, and the end
    column: np.ndarray  # the number of a term's long list, or -1
    lists: np.ndarray  # [list, block, example]
    most: np.ndarray  # [list, block]
    norms: np.ndarray  # of the examples' parts in long lists

    @classmethod
    def build(cls, ids, labels, first, term, weight, telling) -> Index:
        n, n_terms = len(ids), len(telling)
        order = likeness(n, first, term, weight, n_terms)
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        example = place[np.repeat(np.arange(n), np.diff(first))]
        by_term = np.lexsort((example, term))
        t, e, w = term[by_term], example[by_term], weight[by_term].astype(np.float32)
        counts = np.bincount(t, minlength=n_terms)
        long = np.argsort(-counts, kind="stable")[:COLUMNS]
        long = long[counts[long] * LONG >= n]
        column = np.full(n_terms, -1)
        column[long] = np.arange(len(long))
        dense = column[t] >= 0
        lists = np.zeros((len(long), -(-n // BLOCK) * BLOCK), np.float32)
        lists[column[t[dense]], e[dense]] = w[dense]
        lists = lists.reshape(len(long), -1, BLOCK)
        most = lists.max(axis=2)
        t, e, w = t[~dense], e[~dense], w[~dense]
        return cls(ids[order], labels[order].astype(float), telling.astype(np.float32), e, w, np.searchsorted(t, np.arange(n_terms + 1)), column, lists, most, np.sqrt(np.bincount(example[column[term] >= 0], weight[column[term] >= 0] ** 2, n)))

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without=None, read: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k examples of the largest cosines above 0, those, and their telling parts; ``without``: an id."""
        return next(iter(self.nearest_all([(term, weight, without)], k, read)))

    def nearest_all(self, queries: list[tuple], k: int, read: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same of many queries (term, weight, without), QUERIES at a time: of the long lists the blocks that some query
        of these needs are read, in one product. ``read`` is told how many weights were read, and how many there are."""
        n, flat = len(self.ids), self.lists.reshape(len(self.lists), self.lists.shape[1] * BLOCK)
        for at in range(0, len(queries), QUERIES):
            asked = [_Query(self, flat, k, *q) for q in queries[at : at + QUERIES]]
            needed = np.flatnonzero(np.logical_or.reduceat(np.logical_or.reduce([a.late for a in asked]), np.arange(0, n, BLOCK)))
            rows = (needed[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            rows = rows[rows < n]
            full = np.zeros((len(asked), len(self.lists)), np.float32)
            for i, a in enumerate(asked):
                full[i, a.column] = a.q
            common = full @ (self.lists[:, needed].reshape(len(self.lists), len(needed) * BLOCK)[:, : len(rows)] if len(needed) < self.lists.shape[1] else flat[:, :n])
            for a, own in zip(asked, common, strict=True):
                if read is not None:
                    read.append((int(a.late.sum() + len(a.first)) * len(a.q), n * len(a.q)))
                yield a.best(rows, own)


class _Query:
    """One query: bounds of all examples by its short lists and the maxima of its long ones, and the first examples."""

    def __init__(self, index: Index, flat: np.ndarray, k: int, term: np.ndarray, weight: np.ndarray, without) -> None:
        self.index, self.flat, self.k, self.without = index, flat, k, without
        n = len(index.ids)
        self.tell = index.telling[term]
        place, self.which = ranges(index.first[term], index.first[term + 1], np.arange(len(term)))
        self.part, self.at = weight[self.which] * index.weights[place], index.postings[place]
        self.short = np.bincount(self.at, self.part, n)
        self.own = index.column[term] >= 0
        self.column, self.q = index.column[term[self.own]], weight[self.own]
        # The maxima bound a block; within it, no example's part exceeds the product of the lengths.
        bound = self.short + np.minimum(np.repeat(self.q @ index.most[self.column], BLOCK)[:n], np.sqrt(self.q @ self.q) * index.norms)
        if without is not None:
            bound[index.ids == without] = 0
        self.first = np.argpartition(bound, -min(k, n))[-min(k, n) :]
        self.known = self.short[self.first] + self.exact(self.first, self.q)
        self.least = max(self.known.min(), 0) if n > k else 0
        self.late = (bound > 0) & (bound >= self.least - SLACK)
        self.late[self.first] = False

    def exact(self, rows: np.ndarray, by: np.ndarray) -> np.ndarray:
        """What long lists give to the rows. They are added up in their order, so an example's sum doesn't depend on
        what else is read."""
        return (self.flat[np.ix_(self.column, rows)] * by[:, None]).sum(0)

    def best(self, rows: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k examples, given the sums of single precision of the rows' long lists, which tell what can be among them."""
        index, k = self.index, self.k
        own = np.flatnonzero(self.late[rows])
        rows, rough = rows[own], self.short[rows[own]] + common[own]
        least = max(self.least, np.partition(rough, -k)[-k] - SINGLE) if len(rough) > k else self.least
        rows = rows[(rough > 0) & (rough >= least - SINGLE)]
        rows, scores = np.concatenate([self.first, rows]), np.concatenate([self.known, self.short[rows] + self.exact(rows, self.q)])
        if self.without is not None:
            scores[index.ids[rows] == self.without] = 0
        sims = np.round(scores, 12)
        near = np.flatnonzero(sims > 0)
        near = near[np.lexsort((index.ids[rows[near]], -sims[near]))[:k]]
        best = rows[near]
        # The same sums with terms as telling as they are, of the k alone.
        number = np.zeros(len(index.ids), np.int16)
        number[best] = np.arange(1, len(best) + 1)
        number = number[self.at]
        mine = np.flatnonzero(number)
        told = np.bincount(number[mine], self.part[mine] * self.tell[self.which[mine]], len(best) + 1)[1:]
        return best, scores[near], told + self.exact(best, self.q * self.tell[self.own])


@dataclass
class Model:
    terms: np.ndarray
    idf: np.ndarray
    index: Index | None
    base: float  # the rate of label 1 among the examples
    bare: float  # and among those without a term
    slope: float = 1.0
    shift: float = 0.0

    def vote(self, term, weight, without=None) -> tuple[float, np.ndarray, np.ndarray]:
        return next(iter(self.votes([(term, weight, without)])))

    def votes(self, queries: list[tuple]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each query (term, weight, without) the share of label 1 in the votes of the neighbours, with PRIOR_MASS votes for
        the examples' rate, and the neighbours with their cosines."""
        for at, sims, telling in self.index.nearest_all(queries, NEIGHBOURS):
            pull = telling + LEAST_PULL
            yield float((pull @ self.index.labels[at] + PRIOR_MASS * self.base) / (pull.sum() + PRIOR_MASS)), at, sims

    def calibrated(self, vote: float) -> float:
        return float(_sigmoid(self.slope * np.log(vote / (1 - vote)) + self.shift))


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _rate(y: np.ndarray) -> float:
    return float((y.sum() + 0.5) / (len(y) + 1))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with a small penalty on the slope's distance to 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        w = p * (1 - p)
        g = np.array([((p - y) * x).sum() + (a - 1), (p - y).sum() + 0.01 * b])
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = LABELLED_ROWS) -> Model:
    """At most ``bound`` examples' vectors over the vocabulary reach the driver."""
    examples = jobs.stored(jobs.with_labels(docs, jobs.labelled(labels, label, bound)).dropDuplicates(["doc_id"]))
    terms, telling = vocabulary(examples)
    counts, n = document_counts(docs, terms)
    idf = np.log((1 + n) / (1 + counts)) + 1e-6
    held = docs.sparkSession.sparkContext.broadcast((terms, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textops.chunks(batch.column(1)):
                first, term, weight = vectors(chunk, *held.value)
                rows = batch.slice(chunk.first_row, chunk.rows)
                cut = pa.array(first.astype(np.int32))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.ListArray.from_arrays(cut, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(weight))], ["doc_id", "y", "term", "weight"])

    got = examples.select("doc_id", "text", "y").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, term array<int>, weight array<double>").toArrow().sort_by("doc_id").combine_chunks()
    y = (got.column("y").to_numpy() == 1).astype(float)
    if not len(y):
        return Model(terms, idf, None, 0.5, 0.5)
    lengths = pc.list_value_length(got.column("term")).to_numpy()
    first = np.concatenate(([0], np.cumsum(lengths)))
    model = Model(terms, idf, None, _rate(y), _rate(y[lengths == 0]) if (lengths == 0).any() else _rate(y))
    if not lengths.any():
        return model
    term, weight = (pc.list_flatten(got.column(c)).to_numpy() for c in ("term", "weight"))
    ids = got.column("doc_id").to_numpy()
    model.index = Index.build(ids, y, first, term, weight, telling)
    full = np.flatnonzero(lengths)
    votes = np.array([vote for vote, _, _ in model.votes([(term[first[i] : first[i + 1]], weight[first[i] : first[i + 1]], ids[i]) for i in full])])
    model.slope, model.shift = _logistic(np.log(votes / (1 - votes)), y[full])
    del got, term, weight
    pa.default_memory_pool().release_unused()
    return model


SCHEMA = "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, label: int>>"
EVIDENCE = 3


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence): the calibrated vote, and the nearest examples."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            for chunk in textops.chunks(batch.column(1)):
                scores, evidence = np.full(chunk.rows, m.bare), [[]] * chunk.rows
                if m.index is not None:
                    first, term, weight = vectors(chunk, m.terms, m.idf)
                    full = np.flatnonzero(np.diff(first)).tolist()
                    asked = [(term[first[i] : first[i + 1]], weight[first[i] : first[i + 1]], None) for i in full]
                    for i, (vote, at, sims) in zip(full, m.votes(asked), strict=True):
                        scores[i] = m.calibrated(vote)
                        evidence[i] = [{"doc_id": int(m.index.ids[a]), "cosine": float(s), "label": int(m.index.labels[a])} for a, s in zip(at[:EVIDENCE], sims[:EVIDENCE], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first_row, chunk.rows), pa.array(scores), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op4(spark, sf_dir: str) -> DataFrame:
    jobs.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(jobs.fold(F.col("doc_id")) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
