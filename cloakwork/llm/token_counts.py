"""Token counts: unigram segmentation of distinct pre-tokens over a shared trie.

A pre-token is a word with the word mark before it. The distinct pre-tokens of a batch
form a trie; the best score of every node, over all segmentations of its path into pieces,
is computed once from the nodes above it, level by level, and so once for each shared
prefix. The node at which a pre-token ends holds its token count. Counts are summed over
each document, and a table of the last pre-tokens met spares a task repeated work.

Pieces come from a public vocabulary whose path is a parameter; a piece of rank r has the
score -log(r + SHIFT). Any single byte is a piece too, with the score BYTE_SCORE, so every
text has a segmentation. Of equal scores the one of fewer tokens counts.

The scores are made from ranks, as no public vocabulary here has unigram scores and tokenizers are
never trained; counts thus differ from those of the vocabulary's own merges. A pre-token over
ALONE bytes shares no prefix worth a trie and is scored by itself, by the same recurrence, in
time proportional to its length.

Defined results: a null or empty text has 0 tokens; equal rows get equal results; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm import jobs, textops

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SHIFT, BYTE_SCORE = 16.0, -14.0
ALONE = 256
CACHED = 1 << 18


@dataclass
class Vocabulary:
    """Piece hashes in order, their scores, and which lengths pieces have."""

    hashes: np.ndarray
    scores: np.ndarray
    lengths: np.ndarray
    pieces: dict[bytes, float]

    @classmethod
    def of(cls, pieces: list[bytes]) -> Vocabulary:
        ranks: dict[bytes, int] = {}
        for r, p in enumerate(pieces):
            if p:
                ranks.setdefault(p, r)
        for b in range(256):
            ranks.setdefault(bytes([b]), -1)
        joined = np.frombuffer(b"".join(ranks), np.uint8)
        ends = np.cumsum([len(p) for p in ranks])
        h = prefix_free_hashes(joined, ends - [len(p) for p in ranks], ends)
        r = np.array(list(ranks.values()))
        order = np.argsort(h)
        scores = np.where(r < 0, BYTE_SCORE, -np.log(np.maximum(r, 0) + SHIFT))
        return cls(h[order], scores[order], np.bincount([len(p) for p in ranks]) > 0, dict(zip(ranks, scores.tolist(), strict=True)))

    def score(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.scores[at], -np.inf)


def prefix_free_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans that may be computed from any offset: those of textops."""
    return textops.span_hashes(data, starts, ends)


def load(path: str = VOCABULARY) -> Vocabulary:
    """Reads the pieces of a sentencepiece model on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return Vocabulary.of([p.encode() for p in pieces])


def count_alone(token: bytes, vocabulary: Vocabulary) -> int:
    """The number of tokens of one byte string."""
    lengths = np.flatnonzero(vocabulary.lengths).tolist()
    best, fewest = [0.0], [0]
    for end in range(1, len(token) + 1):
        top, least = -np.inf, 0
        for n in lengths:
            if n > end:
                break
            s = vocabulary.pieces.get(token[end - n : end])
            if s is not None:
                s, k = s + best[end - n], fewest[end - n] + 1
                if s > top + 1e-9 or s > top - 1e-9 and k < least:
                    top, least = s, k
        best.append(top)
        fewest.append(least)
    return fewest[-1]


def trie_counts(tokens: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Numbers of tokens of distinct byte strings, by forward scores over their trie."""
    out = np.zeros(len(tokens), np.int64)
    for i, x in enumerate(tokens):
        if len(x) > ALONE:
            out[i] = count_alone(x, vocabulary)
    order = sorted((i for i, x in enumerate(tokens) if len(x) <= ALONE), key=tokens.__getitem__)
    lengths = np.array([len(tokens[i]) for i in order])
    if not len(lengths) or not lengths.max():
        return out
    starts = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b"".join(tokens[i] for i in order), np.uint8)
    # With the strings in order, a node of depth d starts at each string that differs from the one before within d bytes.
    shared = np.zeros(len(order), np.int64)
    alive = np.ones(len(order) - 1, bool)
    for d in range(int(lengths.max())):
        alive &= (lengths[1:] > d) & (lengths[:-1] > d)
        at = np.flatnonzero(alive)
        if not len(at):
            break
        equal = data[starts[at] + d] == data[starts[at + 1] + d]
        alive[at[~equal]] = False
        shared[at[equal] + 1] += 1
    node = np.zeros(len(order), np.int64)  # of each string, at the current depth
    scores, counts, parents, letters = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.uint8)]
    for d in range(1, int(lengths.max()) + 1):
        own = np.flatnonzero(lengths >= d)
        # ``shared`` is to the string just before, so a run of strings breaks where it is under d, or where a shorter one stands between.
        new = (shared[own] < d) | np.concatenate(([True], np.diff(own) > 1))
        ids = np.cumsum(new) - 1
        first = own[new]
        parents.append(node[first].copy())
        letters.append(data[starts[first] + d - 1])
        best, fewest = np.full(len(first), -np.inf), np.zeros(len(first), np.int64)
        h, above = np.zeros(len(first), np.uint64), np.arange(len(first))
        for back in range(1, min(d, len(vocabulary.lengths) - 1) + 1):
            # The piece's hash grows at its front: value of the letter plus base times what follows.
            level = d - back + 1
            h = textops.BYTE_VALUE[letters[level][above]] + h * np.uint64(textops._BASE)
            above = parents[level][above]
            if not vocabulary.lengths[back]:
                continue
            s = vocabulary.score(textops.mix(h + np.uint64(back))) + scores[d - back][above]
            n = counts[d - back][above] + 1
            better = (s > best + 1e-9) | (s > best - 1e-9) & (n < fewest)
            best, fewest = np.where(better, s, best), np.where(better, n, fewest)
        scores.append(best)
        counts.append(fewest)
        node[own] = ids
        ended = lengths[own] == d
        out[np.array(order)[own[ended]]] = fewest[ids[ended]]
    return out


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every document. Broadcast: the vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, mark = held.value, MARK.encode()
        known, values = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for chunk in textops.chunks(batch.column(1)):
                words = chunk.words()
                h = textops.span_hashes(chunk.data, words.starts, words.ends)
                distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                counts = np.zeros(len(distinct), np.int64)
                at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
                found = known[at] == distinct if len(known) else np.zeros(len(distinct), bool)
                counts[found] = values[at[found]]
                fresh = np.flatnonzero(~found)
                raw = chunk.data.tobytes()
                s, e = words.starts[first[fresh]].tolist(), words.ends[first[fresh]].tolist()
                counts[fresh] = trie_counts([mark + raw[a:b] for a, b in zip(s, e, strict=True)], vocab)
                if len(known) + len(fresh) > CACHED:
                    known, values = distinct, counts
                else:
                    known, values = np.concatenate([known, distinct[fresh]]), np.concatenate([values, counts[fresh]])
                    order = np.argsort(known)
                    known, values = known[order], values[order]
                sums = np.concatenate(([0], np.cumsum(counts[inverse])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first_row, chunk.rows), pa.array(words.counts, pa.int64()), pa.array(sums[words.first[1:]] - sums[words.first[:-1]])], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op7(spark, sf_dir: str) -> DataFrame:
    jobs.prepare(spark)
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), load())
