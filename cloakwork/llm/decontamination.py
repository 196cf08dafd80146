"""Benchmark decontamination by spaced seeds.

Tokens are lower-cased alphanumeric runs. A mask fixes which positions of a span of tokens
are hashed and which are ignored, so two spans that differ at ignored positions hash alike;
several masks together let some substitutions fall anywhere. Hashes of the test items and
of all documents are joined, and every hit is verified: along its diagonal, the segment of
the best score (a match counts 1, a mismatch -3; of equal scores the last and shortest) must
hold LEAST matches, all but one of a shorter item, or all tokens of an item shorter than the span.

No overlap that the verification accepts goes unseeded: every beginning of its segment has
a score over 0, so the first four tokens match, and of the first eight at most one doesn't;
the masks leave out each of the last four places of eight in turn. Items of fewer tokens
than that span are hashed whole.

The test side is broadcast in slices of at most SLICE tokens, a larger item by itself; more
tokens mean more passes over the documents, never a larger broadcast. There is no shuffle
of documents.

Defined results: null and empty texts and items match nothing; an item without an id is
reported with a null; of several places of one
item in a document the one with most matches is reported, the first on a tie; equal rows
are reported once each; an item of fewer than TELLING tokens is reported, but no document goes for
it; extra columns are ignored, and ``drop_contaminated`` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm import jobs, textops

MASKS = ("11110111", "11111011", "11111101", "1111111")
SPAN = 8
LEAST, PENALTY, TELLING = 12, 3, 5
SLICE = 200_000
FILTER_BITS = 22


def tokens_of(chunk: textops.Chunk) -> tuple[textops.Words, np.ndarray]:
    words = chunk.words(textops.NON_ALNUM)
    return words, textops.span_hashes(textops.LOWER[chunk.data], words.starts, words.ends)


def masked_hashes(tokens: np.ndarray, places: list[int], seed: int) -> np.ndarray:
    """Hashes of the tokens at the places of a span, for every start of a span."""
    n = len(tokens) - places[-1]
    h = np.zeros(max(n, 0), np.uint64)
    for p in places if n > 0 else ():
        h = h * np.uint64(textops._BASE) + tokens[p : p + n]
    return textops.mix(h, 100 + seed)


def seeds(shortest: set[int]) -> list[list[int]]:
    """Positions of each mask, and of the whole of each length under the span."""
    return [[i for i, c in enumerate(m) if c == "1"] for m in MASKS] + [list(range(n)) for n in sorted(shortest) if 0 < n < SPAN]


def least_matches(n: int) -> int:
    """How many matches an item of n tokens asks for."""
    return min(LEAST, n - 1) if n >= SPAN else n


def repeats(h: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks the spans that hash as the one a token before them in the same text does."""
    out = np.zeros(len(at), bool)
    out[1:] = (at[1:] == at[:-1] + 1) & (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    return out


@dataclass
class Items:
    """Test items of a slice: tokens end to end, and their seeds' hashes in order."""

    ids: list
    first: np.ndarray
    tokens: np.ndarray
    places: list[list[int]]
    #: Of all seeds, and of those that don't repeat the one before: (hashes, where the span starts in ``tokens``).
    all: tuple[np.ndarray, np.ndarray]
    heads: tuple[np.ndarray, np.ndarray]
    present: np.ndarray

    @classmethod
    def of(cls, ids: list, lists: list[np.ndarray]) -> Items:
        lengths = np.array([len(x) for x in lists], np.int64)
        first = np.concatenate(([0], np.cumsum(lengths)))
        tokens = np.concatenate([*lists, np.empty(0, np.uint64)])
        places, hashes, starts, again = seeds(set(lengths.tolist())), [], [], []
        owner = np.repeat(np.arange(len(lists)), lengths)
        for k, p in enumerate(places):
            at = np.arange(max(len(tokens) - p[-1], 0))
            own = at[owner[at] == owner[at + p[-1]]]
            if k >= len(MASKS):  # whole items of that length
                own = own[lengths[owner[own]] == len(p)]
            hashes.append(masked_hashes(tokens, p, k)[own])
            starts.append(own)
            again.append(repeats(hashes[-1], own, owner[own]))
        h, s, again = np.concatenate(hashes), np.concatenate(starts), np.concatenate(again)
        order = np.argsort(h, kind="stable")
        heads = order[~again[order]]
        present = np.zeros(1 << FILTER_BITS, bool)
        present[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return cls(ids, first, tokens, places, (h[order], s[order]), (h[heads], s[heads]), present)

    def telling(self, item: int) -> bool:
        return self.first[item + 1] - self.first[item] >= TELLING

    def find(self, chunk: textops.Chunk) -> list[tuple[int, int, int, int, int]]:
        """(row, item, matches, start, end) of verified overlaps; tokens of the row. Where the
        document and the item both repeat a token, one seed stands for each diagonal."""
        words, tokens = tokens_of(chunk)
        hits = []
        for k, p in enumerate(self.places):
            h = masked_hashes(tokens, p, k)
            at = np.flatnonzero(self.present[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            at = at[words.row[at] == words.row[at + p[-1]]]
            again = repeats(h[at], at, words.row[at])
            for (hashes, starts), some in ((self.all, at[~again]), (self.heads, at[again])):
                a, b = np.searchsorted(hashes, h[some], "left"), np.searchsorted(hashes, h[some], "right")
                n = b - a
                own = np.repeat(some, n)
                place = starts[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                hits.append(np.column_stack([own - place, np.searchsorted(self.first, place, "right") - 1, words.row[own]]))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for diagonal, item, row in np.unique(np.concatenate(hits), axis=0).tolist():
            found = self.verify(tokens, words.first[row], words.first[row + 1], diagonal, item)
            if found and found[0] > best.get((row, item), (0,))[0]:
                best[row, item] = found
        return [(row, item, *found) for (row, item), found in sorted(best.items())]

    def verify(self, tokens: np.ndarray, low: int, high: int, diagonal: int, item: int) -> tuple[int, int, int] | None:
        """The best segment along the diagonal, if it holds enough matches."""
        a, b = max(low, self.first[item] + diagonal), min(high, self.first[item + 1] + diagonal)
        equal = tokens[a:b] == self.tokens[a - diagonal : b - diagonal]
        sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -PENALTY))))
        lowest = np.minimum.accumulate(sums)
        end = len(sums) - 1 - int((sums - lowest)[::-1].argmax())
        start = end - int(sums[: end + 1][::-1].argmin())
        matches = int(equal[start:end].sum())
        if matches < least_matches(self.first[item + 1] - self.first[item]):
            return None
        return matches, int(a + start - low), int(a + end - low)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in textops.chunks(batch.column(1)):
            words, tokens = tokens_of(chunk)
            lists = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(tokens.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first_row, chunk.rows), lists, pa.array(words.counts, pa.int64())], ["item_id", "tokens", "n"])


def slices(items: DataFrame, bound: int = SLICE) -> Iterator[Items]:
    """The test side, at most about ``bound`` tokens at a time."""
    rows = items.select(F.col("item_id").cast("long"), "text").mapInArrow(_tokens, "item_id long, tokens array<long>, n long").where("n > 0")
    rows = jobs.stored(rows.dropDuplicates(["item_id", "tokens"]))
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = -(-2 * total // bound) if total > bound else 1
    for k in range(parts):
        got = rows.where(F.pmod(F.xxhash64("item_id", "tokens"), F.lit(parts)) == k).select("item_id", "tokens").collect()
        if got:
            got.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["tokens"]))
            yield Items.of([r["item_id"] for r in got], [np.array(r["tokens"], np.int64).view(np.uint64) for r in got])


SCHEMA = "doc_id long, item_id long, n_matched long, first_token long, end_token long"


def find_overlaps(docs: DataFrame, items: DataFrame, bound: int = SLICE) -> DataFrame:
    """Verified overlaps, a row for each document and item."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), "text")

    def search(held) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk in textops.chunks(batch.column(1)):
                    found = held.value.find(chunk)
                    if found:
                        row, item, matches, start, end = zip(*found, strict=True)
                        own = batch.column(0).take(pa.array(np.array(row) + chunk.first_row))
                        yield pa.RecordBatch.from_arrays([own, pa.array([held.value.ids[i] for i in item], pa.int64()), *(pa.array(x, pa.int64()) for x in (matches, start, end))], [x.split()[0] for x in SCHEMA.split(", ")])

        return run

    out = None
    for part in slices(items, bound):
        found = rows.mapInArrow(search(context.broadcast(part)), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, items: DataFrame, bound: int = SLICE) -> DataFrame:
    """The documents, with their columns, that overlap no item of TELLING tokens or more."""
    context, at = docs.sparkSession.sparkContext, docs.columns.index("text")
    rows = jobs.numbered(docs)

    def clean(held) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for chunk in textops.chunks(batch.column(at)):
                    keep[[chunk.first_row + f[0] for f in held.value.find(chunk) if held.value.telling(f[1])]] = False
                yield batch.filter(pa.array(keep))

        return run

    for part in slices(items, bound):
        rows = rows.mapInArrow(clean(context.broadcast(part)), rows.schema)
    return rows.toDF(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    jobs.prepare(spark)
    return find_overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
