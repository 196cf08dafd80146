"""Substring dedup: words covered by a repeated window of WINDOW words go.

Every window of every document gets a rolling (Rabin-Karp) hash of 64 bits. Tasks sort
the hashes of about BLOCK windows, keep one entry for each distinct hash, and deal the
entries out by ranges of the hash; so a passage that a third of all rows share costs one
entry a block. Each range is counted on its own: a hash found in two blocks, or twice in
one, is repeated. The positions of repeated windows go back to their blocks and merge into
maximal intervals of words for each document. Nothing but the intervals is joined to the
texts. A window is wrongly taken as repeated with probability of at most the number of
windows / 2**64.

The documents are read twice, and each document is known by its id and the hash of its
text. Defined results: a null or empty text has no words and nothing to remove; a text of
fewer words than a window keeps all; rows that are equal in id and text are removed whole
when they have a window, as each repeats the other; null ids are kept apart by text; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm import jobs, textops

WINDOW = 35
BLOCK = 1 << 20
#: Bytes of a hash within its range; the range is the first byte at least.
ENTRY = 7

_ROWS = "range long, block long, entries binary, positions binary, known binary, ids array<long>, hashes array<long>, windows array<long>"
_HITS = "block long, positions binary, ids array<long>, hashes array<long>, windows array<long>"


def _pack(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ENTRY]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // ENTRY, 8), np.uint8)
    out[:, :ENTRY] = np.frombuffer(b, np.uint8).reshape(-1, ENTRY)
    return out.view("<u8").ravel()


def _table(kind: str, rows: list[dict]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split(" ") for x in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types[t]) for n, t in fields], [n for n, _ in fields])


def window_items(window: int):
    """(hashes, number of each row) of a chunk's windows."""

    def items(chunk: textops.Chunk) -> tuple[np.ndarray, np.ndarray]:
        words = chunk.words()
        at = words.windows(window)
        h = textops.window_hashes(textops.span_hashes(chunk.data, words.starts, words.ends), window)
        return h[at] if len(at) else h[:0], np.maximum(words.counts - window + 1, 0)

    return items


def deal(items, bits: int):
    """Blocks of the items' hashes by range, and what is needed to read positions back; for
    rows (id, hash, text)."""

    def block_rows(block: int, ids: list, texts: list, windows: list, hashes: list) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(s))) > 1
        local = order[np.repeat(many, np.diff(np.append(first, len(s))))]
        yield _table(_ROWS, [{"range": -1 - block, "block": block, "ids": np.concatenate(ids).tolist(), "hashes": np.concatenate(texts), "windows": np.concatenate(windows), "positions": local.astype("<u4").tobytes()}])
        s, at = s[first], order[first].astype("<u4")
        ranges = (s >> np.uint64(64 - bits)).astype(np.int64)
        rows, size = [], 0
        edges = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            m = many[a:b]
            rows.append({"range": int(ranges[a]), "block": block, "entries": _pack(s[a:b][~m]), "positions": at[a:b][~m].tobytes(), "known": _pack(s[a:b][m])})
            size += b - a
            if size > 1 << 18:
                yield _table(_ROWS, rows)
                rows, size = [], 0
        if rows:
            yield _table(_ROWS, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        pending, total = ([], [], [], []), 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False).astype(object), batch.column(1).to_numpy()
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = np.where(missing, None, ids)
            for chunk in textops.chunks(batch.column(2)):
                h, n = items(chunk)
                if not len(h):
                    continue
                own = chunk.first_row + np.flatnonzero(n)
                for x, y in zip(pending, (ids[own], texts[own], n[n > 0], h), strict=True):
                    x.append(y)
                total += len(h)
                if total >= BLOCK:
                    yield from block_rows(block, *pending)
                    block, pending, total = block + 1, ([], [], [], []), 0
        if total:
            yield from block_rows(block, *pending)

    return run


def _count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions, by block, of a range's windows whose hash is found anywhere else."""
    if key[0].as_py() < 0:
        for batch in batches:
            yield batch.select([x.split(" ")[0] for x in _HITS.split(", ")])
        return
    blocks, entries, positions, known = [], [], [], []
    for batch in batches:
        for r in batch.select(["block", "entries", "positions", "known"]).to_pylist():
            blocks.append(r["block"])
            entries.append(_unpack(r["entries"]))
            positions.append(np.frombuffer(r["positions"], "<u4"))
            known.append(_unpack(r["known"]))
    h = np.concatenate(entries)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    repeated = np.empty(len(s), bool)
    repeated[order] = same[:-1] | same[1:]
    twice = np.unique(np.concatenate(known))
    if len(twice):
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        repeated |= twice[at] == h
    rows, at = [], 0
    for block, p in zip(blocks, positions, strict=True):
        own = p[repeated[at : at + len(p)]]
        at += len(p)
        if len(own):
            rows.append({"block": block, "positions": own.tobytes()})
    yield _table(_HITS, rows)


def read_block(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, dict]:
    """Positions of a block, in order, and its rows."""
    found, head = [], None
    for batch in batches:
        for r in batch.to_pylist():
            found.append(np.frombuffer(r["positions"], "<u4"))
            head = r if r["ids"] is not None else head
    return np.sort(np.concatenate(found)).astype(np.int64), head


def _intervals(window: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Maximal intervals of covered words of each document of a block."""
        p, head = read_block(batches)
        if len(p):
            edges = np.concatenate(([0], np.cumsum(head["windows"])))
            doc = np.searchsorted(edges, p, "right") - 1
            word = p - edges[doc]
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (word[1:] > word[:-1] + window)))
            starts, ends, own = word[new], word[np.append(new[1:], True)] + window, doc[new]
            cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            lists = pa.array(np.append(cut, len(own)).astype(np.int32))
            some = own[cut]
            yield pa.RecordBatch.from_arrays([pa.array([head["ids"][i] for i in some], pa.int64()), pa.array([head["hashes"][i] for i in some], pa.int64()), pa.ListArray.from_arrays(lists, pa.array(starts)), pa.ListArray.from_arrays(lists, pa.array(ends))], ["id", "hash", "starts", "ends"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("hash"), "text")


def repeated(rows: DataFrame, items) -> DataFrame:
    """By block: the positions of items that are found elsewhere, and the block's rows."""
    bits = max(8, (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    return jobs.stored(rows.mapInArrow(deal(items, bits), _ROWS).groupBy("range").applyInArrow(_count, _HITS))


def removal_intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, hash, starts, ends): the intervals of words to remove, [start, end), of the
    documents that have any; one row for each distinct id and text."""
    hits = repeated(keyed(docs), window_items(window))
    found = hits.groupBy("block").applyInArrow(_intervals(window), "id long, hash long, starts array<long>, ends array<long>")
    return found.dropDuplicates(["id", "hash"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, starts, ends in zip(*(batch.column(k) for k in ("text", "starts", "ends")), strict=True):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            n_words.append(len(words))
            if starts.is_valid:
                left, at = [], 0
                for s, e in zip(starts.as_py(), ends.as_py(), strict=True):
                    left += words[at:s]
                    at = e
                words = left + words[at:]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every document; kept words are joined by
    one space."""
    left = keyed(docs).withColumn("k", F.coalesce("id", F.lit(0)))
    right = removal_intervals(docs, window).select(F.coalesce("id", F.lit(0)).alias("k"), "hash", "starts", "ends")
    rows = left.join(right, ["k", "hash"], "left").select(F.col("id").alias("doc_id"), "text", "starts", "ends")
    return rows.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")


def op8(spark, sf_dir: str) -> DataFrame:
    jobs.prepare(spark)
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
windows as (
  select doc_id, i, array_to_string(ws[i:i + 34], ' ') as s
  from (select doc_id, ws, unnest(generate_series(1, len(ws) - 34)) as i from w where len(ws) >= 35)
),
again as (select s from windows group by s having count(*) > 1),
gone as (select distinct doc_id, i + k as p from windows join again using (s), generate_series(0, 34) as t(k)),
words as (select doc_id, unnest(ws) as word, unnest(generate_series(1, len(ws))) as p from w),
kept as (
  select words.doc_id, string_agg(word, ' ' order by words.p) as t, count(*) as n
  from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p where gone.p is null group by words.doc_id
)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)
"""
