"""MinHash near-dedup by an inverted join of signature coordinates.

Two documents are linked when the Jaccard similarity of their sets of 5-word shingles is
at least 75%; the result is the connected components of the links.

1. One scan makes each document's set size, a 128-bit digest of the set and a signature of
   COORDINATES minima. Documents of equal sets fall into one class at once.
2. Every class is posted under its coordinate-value pairs. Linked classes agree on at least
   MATCHES of the first POSTED coordinates but for about 1 in 10**8, so, with the pairs of
   each class in one global order, rarest first by a table of hashed counts of fixed size,
   two linked classes share one of their first POSTED - MATCHES + 1 pairs: the prefix. The
   frequent pairs that shared passages bring are thus skipped.
3. Lists are merged in tasks, never as rows of pairs: the members of a list are in order of
   size, a member is held against those that its size allows, skipping what is joined with
   it, and their collisions are counted over all coordinates. Pairs of at least COLLISIONS
   (missed by a link once in 10**8) are candidates; a task emits a forest of them.
4. A list of more than LIST members comes from a large group of near copies or from a
   passage that many documents share. Members of which more than a quarter of the shingles
   is in no other such list can't be linked with a member and leave; what then still is
   longer than LIST becomes a star of candidates, without comparison.
5. A component of very many members is first taken apart: of each set the rarest of its shingles are posted, and
   members that share none of these can't be linked. A template's copies with texts of their own fall apart so.
6. The components of the candidates are verified on the full sets, again in tasks that skip
   what is joined. One of at most GROUP members and GROUP_SHINGLES shingles is one task's
   work. A larger one is cut into blocks: neighbouring blocks are joined first, which makes
   a component of most members; then the members outside of the largest component are held
   against all blocks. So no link between different texts is lost, no row stands for a
   pair, and a large group of near copies costs a few comparisons for each member.

Components are found by alternating large-star and small-star steps on tables in the shared
folder. Nothing but counts and tables of fixed size reaches the driver.

Defined results: a null, empty or blank text has an empty set, size 0, and is linked with
nothing; fewer than 5 words are one shingle; every row is a document of its own, also where
ids repeat: equal rows are all returned, and rows of one id with unlike texts are in
components of their own; a null id is never the smallest, and the component of null ids alone
is null; ``keep_one`` keeps one row of each component: that of the least id, null last, then of
the least text hash, and all rows of empty sets; extra columns are ignored by
``near_duplicates`` and kept by ``keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.llm import jobs, substring_dedup, textops

SHINGLE, PERCENT = 5, 75
COORDINATES, POSTED, MATCHES, COLLISIONS = 128, 48, 18, 69
TABLE, SLICES = 1 << 20, 16
#: Members of a list that one task compares; members and shingles of a component that one task verifies, and of its blocks.
LIST = 1024
GROUP, GROUP_SHINGLES = 2048, 1 << 22
#: Bits of the filter by which the second scan skips documents that are in no list.
FILTER_BITS = 1 << 25
#: A component of more blocks is taken apart first; what crossing these costs grows with their square.
CROSSED = 8
#: Buckets of the counts of shingles in such components.
SET_TABLE = 1 << 21

_FACTORS = textops.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64), 77) | np.uint64(1)


def shingles(chunk: textops.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the shingle hashes of each row, repeats included."""
    words = chunk.words()
    h = textops.span_hashes(textops.LOWER[chunk.data], words.starts, words.ends)
    at = words.windows(SHINGLE)
    hashes, rows = [textops.window_hashes(h, SHINGLE)[at] if len(at) else np.empty(0, np.uint64)], [words.row[at]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(words.counts == n)
        x = np.zeros(len(short), np.uint64)
        for k in range(n):
            x = x * np.uint64(textops._BASE) + h[words.first[short] + k]
        hashes.append(textops.mix(x, 10 + n))
        rows.append(short)
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return np.concatenate(hashes)[order], np.searchsorted(row[order], np.arange(chunk.rows + 1))


def distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, sorted within rows and without repeats."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(first)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in textops.chunks(batch.column(1)):
            h, first = distinct(*shingles(chunk))
            full = np.flatnonzero(np.diff(first))
            minima = np.zeros((chunk.rows, COORDINATES), np.uint32)
            if len(full):
                for k, factor in enumerate(_FACTORS):
                    minima[full, k] = np.minimum.reduceat(h * factor, first[full]) >> np.uint64(32)
            columns = [pa.array(np.diff(first).astype(np.int64)), *(pa.array(_sums(textops.mix(h, s), first).view(np.int64)) for s in (20, 21))]
            posted = pa.array([x.tobytes() for x in minima[:, :POSTED]], pa.binary())
            signature = pa.array([x.tobytes() for x in textops.mix(minima.astype(np.uint64)).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first_row, chunk.rows), batch.column(2).slice(chunk.first_row, chunk.rows), *columns, posted, signature], ["doc_id", "x", "n", "d1", "d2", "posted", "signature"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, x, n, d1, d2, posted, signature): a hash of the text, the set's size and digest,
    the minima of the posted coordinates, and a byte for each of all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("x"))
    return rows.mapInArrow(_signatures, "doc_id long, x long, n long, d1 long, d2 long, posted binary, signature binary")


def classes(signed: DataFrame) -> DataFrame:
    """(node, id, n, d1, d2, posted, signature): one row for each distinct set with its smallest
    id. The node is a number that holds for the stored table only."""
    rows = signed.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id"), F.min("posted").alias("posted"), F.min("signature").alias("signature"))
    return jobs.stored(rows.withColumn("node", F.monotonically_increasing_id()))


def _pairs_of(column: pa.Array) -> np.ndarray:
    """Hashes of the coordinate-value pairs, a row for each class."""
    minima = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, POSTED)
    return textops.mix(minima.astype(np.uint64) << np.uint64(8) | np.arange(POSTED, dtype=np.uint64), 30)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(TABLE, np.uint32)
    for batch in batches:
        total += np.bincount((_pairs_of(batch.column(0)) % np.uint64(TABLE)).astype(np.int64).ravel(), minlength=TABLE).astype(np.uint32)
    if total.any():
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "bytes": [x.tobytes() for x in np.split(total, SLICES)]})


def _bit_lengths(key: tuple, batches: Iterator[pa.RecordBatch], table: int, read=lambda x: x) -> Iterator[pa.RecordBatch]:
    total = np.zeros(table // SLICES, np.int64)
    for batch in batches:
        for x in batch.column("bytes"):
            total += np.frombuffer(read(x.as_py()), np.uint32)
    yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "bytes": [np.ceil(np.log2(total + 1)).astype(np.uint8).tobytes()]})


def _levels(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _bit_lengths(key, batches, TABLE)


def _set_levels(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _bit_lengths(key, batches, SET_TABLE, zlib.decompress)


def _gathered(slices: DataFrame, size: int) -> np.ndarray:
    """The slices of a table of fixed size, one after the other."""
    out = np.zeros((SLICES, size // SLICES), np.uint8)
    for r in slices.collect():
        out[r["slice"]] = np.frombuffer(r["bytes"], np.uint8)
    return out.ravel()


def frequency_levels(nodes: DataFrame) -> np.ndarray:
    """The bit length of the count of each of TABLE hash buckets of pairs."""
    kind = "slice int, bytes binary"
    return _gathered(nodes.select("posted").mapInArrow(_tally, kind).groupBy("slice").applyInArrow(_levels, kind), TABLE)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Two places of the filter for each id."""
    h = textops.mix(ids.astype(np.int64).view(np.uint64), 40)
    return np.stack([h % np.uint64(FILTER_BITS), (h >> np.uint64(32)) * np.uint64(5) % np.uint64(FILTER_BITS)]).astype(np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marked = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        marked[_bits(batch.column(0).drop_null().to_numpy()).ravel()] = True
    parts = [(i, x) for i, x in enumerate(np.split(marked, SLICES)) if x.any()]
    yield pa.RecordBatch.from_pydict({"slice": pa.array([i for i, _ in parts], pa.int32()), "bytes": pa.array([np.packbits(x).tobytes() for _, x in parts], pa.binary())})


def _either(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(FILTER_BITS // 8 // SLICES, np.uint8)
    for batch in batches:
        for x in batch.column("bytes"):
            total |= np.frombuffer(x.as_py(), np.uint8)
    yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "bytes": [total.tobytes()]})


def id_filter(ids: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits that passes all of the ids; when it is too small for them it passes
    others too, which a join drops."""
    kind = "slice int, bytes binary"
    return _gathered(ids.mapInArrow(_mark, kind).groupBy("slice").applyInArrow(_either, kind), FILTER_BITS // 8)


def postings(nodes: DataFrame, levels: np.ndarray) -> DataFrame:
    """(pair, node) of each class's prefix."""
    held = nodes.sparkSession.sparkContext.broadcast(levels)
    prefix = POSTED - MATCHES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = _pairs_of(batch.column(1))
            level = held.value[(pairs % np.uint64(TABLE)).astype(np.int64)].astype(np.uint64)
            # The order is by level and then by the pair's own hash; the last bits make room for the level.
            order = np.argsort(level << np.uint64(56) | pairs >> np.uint64(8), axis=1, kind="stable")[:, :prefix]
            own = np.take_along_axis(pairs, order, 1)
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), prefix))], ["pair", "node"])

    return nodes.select("node", "posted").mapInArrow(run, "pair long, node long")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, size: int = 1 << 23) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each group begins, of rows that are in order of the key;
    of about ``size`` bytes, or one group where that is larger."""
    held: list[pa.RecordBatch] = []
    total = 0

    def cut(rest: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, total
        table = pa.Table.from_batches(held).combine_chunks()
        k = table.column(key).to_numpy()
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        if rest:
            held, total = [], 0
            yield table, np.append(first, len(k))
        elif len(first) > 1:
            end = int(first[-1])
            held = table.slice(end).to_batches()
            total = sum(b.nbytes for b in held)
            yield table.slice(0, end), first

    limit = size
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            total += batch.nbytes
            if total >= limit:
                yield from cut(False)
                limit = size if total < size // 2 else 2 * total
    if held:
        yield from cut(True)


def spread(sizes: np.ndarray, alike: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Numbers of the components of members in order of size. ``alike(i, others)`` marks the
    members that are linked with i; those that are joined already are not asked for."""
    labels = np.full(len(sizes), -1)
    left, label = np.arange(len(sizes)), 0
    while len(left):
        queue, left = [int(left[0])], left[1:]
        labels[queue] = label
        while queue and len(left):
            i = queue.pop()
            low, high = np.searchsorted(100 * sizes[left], PERCENT * sizes[i], "left"), np.searchsorted(PERCENT * sizes[left], 100 * sizes[i], "right")
            found = left[low:high][alike(i, left[low:high])] if high > low else left[:0]
            if len(found):
                labels[found] = label
                queue += found.tolist()
                left = left[labels[left] < 0]
        label += 1
    return labels


def _stars(nodes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): each member with the least of its component."""
    least = np.full(labels.max() + 1, nodes.max())
    np.minimum.at(least, labels, nodes)
    v = least[labels]
    return nodes[nodes != v], v[nodes != v]


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1).reshape(-1, 2), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the candidates of each list; rows by pair, then size."""
    for table, first in whole_groups(batches, "pair"):
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        k = np.diff(first)
        a = first[:-1][k == 2]
        a = a[((signature[a] == signature[a + 1]).sum(1) >= COLLISIONS) & (PERCENT * n[a + 1] <= 100 * n[a])]
        u, v = [node[a]], [node[a + 1]]
        for begin, end in zip(first[:-1][k > 2], first[1:][k > 2], strict=True):
            own = signature[begin:end]
            x, y = _stars(node[begin:end], spread(n[begin:end], lambda i, others, own=own: (own[others] == own[i]).sum(1) >= COLLISIONS))
            u.append(x)
            v.append(y)
        yield _edges(np.concatenate(u), np.concatenate(v))


def candidates(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): forests of the classes that collide often enough in the lists (pair, node)."""
    rows = lists.select("pair", "node").join(nodes.select("node", "n", "signature"), "node")
    return rows.select("pair", "node", "n", "signature").repartition("pair").sortWithinPartitions("pair", "n").mapInArrow(_collide, "u long, v long")


def _sets(keep: Callable[[], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = keep()
        for batch in batches:
            ids = batch.column(0)
            place = _bits(ids.fill_null(0).to_numpy())
            hit = (marked[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).all(0) | ids.is_null().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(hit))
            for chunk in textops.chunks(batch.column(1)):
                h, first = distinct(*shingles(chunk))
                sets = [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                columns = [pa.array(np.diff(first).astype(np.int64)), *(pa.array(_sums(textops.mix(h, s), first).view(np.int64)) for s in (20, 21)), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first_row, chunk.rows), *columns], ["id", "n", "d1", "d2", "set"])

    return run


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set): the hashes of the shingles, in order, of the wanted classes (node, id, n, d1, d2)."""
    held = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select("id")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sets(lambda: held.value), "id long, n long, d1 long, d2 long, set binary")
    rows = rows.drop("id").join(wanted.select("node", "n", "d1", "d2"), ["n", "d1", "d2"])
    return rows.dropDuplicates(["n", "d1", "d2"]).select("node", "set")


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.array([len(x.as_buffer()) // 8 for x in batch.column("set")])
        at = np.concatenate(([0], np.cumsum(n)))
        h = np.frombuffer(b"".join(batch.column("set").to_pylist()), np.int64)
        for a in range(0, len(h), 1 << 18):
            part = slice(a, a + (1 << 18))
            row = np.searchsorted(at, np.arange(len(h))[part], "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(h[part]), batch.column("node").take(pa.array(row))], ["h", "node"])


def shared_enough(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): the classes of which at least PERCENT of the shingles are in another of these sets;
    the others can't be linked with any of them."""
    items = sets.mapInArrow(_items, "h long, node long")
    # Of each shingle the number of classes and, where it is one, the class: nothing gathers a shingle's classes.
    own = items.groupBy("h").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1").groupBy("node").agg(F.count("*").alias("own"))
    rows = sets.select("node").join(own, "node", "left").join(nodes.select("node", "n"), "node")
    return rows.where(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= PERCENT * F.col("n")).select("node")


def candidate_edges(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): forests of the candidates of all lists."""
    posted = jobs.stored(postings(nodes, frequency_levels(nodes)))
    lists = posted.groupBy("pair").agg(F.count("*").alias("k")).where("k > 1")
    met = jobs.stored(posted.join(lists, "pair").select("pair", "node", "k"))
    jobs.drop(posted)
    short = met.where(F.col("k") <= LIST)
    long = met.where(F.col("k") > LIST)
    if long.isEmpty():
        edges = jobs.stored(candidates(short, nodes))
        jobs.drop(met)
        return edges
    wanted = long.select("node").distinct().join(nodes, "node").select("node", "id", "n", "d1", "d2")
    sets = jobs.stored(sets_of(docs, wanted))
    kept = jobs.stored(shared_enough(sets, nodes))
    jobs.drop(sets)
    long = long.join(kept, "node", "left_semi")
    left = long.groupBy("pair").agg(F.count("*").alias("left"), F.min("node").alias("least"))
    long = jobs.stored(long.select("pair", "node").join(left, "pair"))
    stars = long.where((F.col("left") > LIST) & (F.col("node") > F.col("least"))).select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    short = short.select("pair", "node").unionByName(long.where((F.col("left") > 1) & (F.col("left") <= LIST)).select("pair", "node"))
    edges = jobs.stored(candidates(short, nodes).unionByName(stars))
    jobs.drop(met, kept, long)
    return edges


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the linked nodes, the component being the smallest node."""
    edges = jobs.stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, jobs.stored(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        jobs.drop(last)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before or not now[0]:
            break
        before = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = jobs.stored(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()))
    jobs.drop(edges)
    return out


class Sets:
    """The sets of some classes, by which links are found exactly."""

    def __init__(self, sets: list[bytes]):
        self.sizes = np.array([len(x) // 8 for x in sets], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))
        values, self.codes = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
        self.mask = np.zeros(len(values), bool)

    def alike(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.codes[self.at[i] : self.at[i + 1]]
        self.mask[own] = True
        if 4 * len(others) < len(self.sizes):
            parts = np.concatenate([self.codes[self.at[j] : self.at[j + 1]] for j in others])
            both = np.add.reduceat(self.mask[parts], np.concatenate(([0], np.cumsum(self.sizes[others])[:-1])), dtype=np.int64)
        else:
            both = np.add.reduceat(self.mask[self.codes], self.at[:-1], dtype=np.int64)[others]
        self.mask[own] = False
        return 100 * both >= PERCENT * (self.sizes[i] + self.sizes[others] - both)


def _in_order(table: pa.Table) -> tuple[np.ndarray, Sets, pa.Table]:
    """Nodes and sets of a group, each class once, in order of size."""
    table = table.take(pa.array(np.unique(table.column("node").to_numpy(), return_index=True)[1]))
    size = np.array([len(x.as_buffer()) for x in table.column("set")], np.int64)
    table = table.take(pa.array(np.argsort(size, kind="stable")))
    return table.column("node").to_numpy(), Sets(table.column("set").to_pylist()), table


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the links of each group."""
    for table, first in whole_groups(batches, "key"):
        u, v = [], []
        for a, b in zip(first[:-1], first[1:], strict=True):
            nodes, sets, _ = _in_order(table.slice(a, b - a))
            x, y = _stars(nodes, spread(sets.sizes, sets.alike))
            u.append(x)
            v.append(y)
        yield _edges(np.concatenate(u), np.concatenate(v))


def _verify_outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the outer members of each group with members of other components."""
    for table, first in whole_groups(batches, "key"):
        u, v = [], []
        for a, b in zip(first[:-1], first[1:], strict=True):
            group = table.slice(a, b - a)
            # An outer member that is in the block as well counts as outer.
            group = group.take(pa.array(np.argsort(~group.column("outer").to_numpy(), kind="stable")))
            nodes, sets, group = _in_order(group)
            label = np.unique(group.column("own").to_numpy(), return_inverse=True)[1]
            for i in np.flatnonzero(group.column("outer").to_numpy()):
                others = np.flatnonzero(label != label[i])
                for j in others[sets.alike(i, others)] if len(others) else ():
                    if label[j] != label[i]:
                        u.append(nodes[i])
                        v.append(nodes[j])
                        label[label == label[j]] = label[i]
        yield _edges(np.array(u, np.int64), np.array(v, np.int64))


def _by_key(rows: DataFrame, run, *columns: str) -> DataFrame:
    return rows.select("key", "node", *columns, "set").repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def _set_tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SET_TABLE, np.uint32)
    for batch in batches:
        for x in batch.column(0):
            at, n = np.unique(np.frombuffer(x.as_py(), np.uint64) % np.uint64(SET_TABLE), return_counts=True)
            total[at.astype(np.int64)] += n.astype(np.uint32)
    # A task meets few of the buckets: what it sends is as long as these, not as the table.
    parts = [(i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(np.split(total, SLICES)) if x.any()]
    yield pa.RecordBatch.from_pydict({"slice": pa.array([i for i, _ in parts], pa.int32()), "bytes": pa.array([x for _, x in parts], pa.binary())})


def _prefixes(held) -> Callable:
    """The rarest shingles of each set, so many that sets which can be linked share one of them: of the smaller set, or of
    both of equal sizes, among those marked ``few``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = held.value
        for batch in batches:
            kept, few, sizes = [], [], []
            for x in batch.column("set"):
                h = np.frombuffer(x.as_py(), np.uint64)
                # A link shares at least PERCENT of the shingles of either set, and of the smaller one the part that it must
                # share with a set of its own size.
                most = len(h) + (-PERCENT * len(h)) // 100 + 1
                own = len(h) + (-2 * PERCENT * len(h)) // (100 + PERCENT) + 1
                kept.append(h[np.lexsort((h, level[h % np.uint64(SET_TABLE)]))[:most]])
                few.append(np.arange(len(kept[-1])) < own)
                sizes.append(len(h))
            if kept:
                row = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
                columns = [batch.column(c).take(pa.array(row)) for c in ("node", "component")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kept).view(np.int64)), *columns, pa.array(np.array(sizes, np.int64)[row]), pa.array(np.concatenate(few))], ["h", "node", "component", "n", "few"])

    return run


def _blocks() -> Column:
    """The blocks of a component of so many members and shingles."""
    return F.greatest(F.ceil(F.col("members") / (GROUP // 2)), F.ceil(F.col("shingles") / (GROUP_SHINGLES // 2))).cast("int")


def refined(sets: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The components of the candidates, of which those of more than CROSSED blocks are taken apart: members stay together only
    by a shingle among the rarest of both, without which they can't be linked. What shares no more than
    frequent shingles, such as a template's, falls apart, whatever its number."""
    size = found.join(nodes.select("node", "n"), "node").groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    large = jobs.stored(found.join(size.where(_blocks() > CROSSED).select("component"), "component"))
    own, kind = sets.join(large, "node"), "slice int, bytes binary"
    held = sets.sparkSession.sparkContext.broadcast(_gathered(own.select("set").mapInArrow(_set_tally, kind).groupBy("slice").applyInArrow(_set_levels, kind), SET_TABLE))
    posted = jobs.stored(own.select("set", "node", "component").mapInArrow(_prefixes(held), "h long, node long, component long, n long, few boolean"))
    least = posted.where("few").groupBy("component", "h").agg(F.min(F.struct("n", "node")).alias("s"))
    met = posted.join(least, ["component", "h"]).where("node <> s.node and (few or n > s.n)")
    stars = jobs.stored(met.select(F.col("node").alias("u"), F.col("s.node").alias("v")).distinct())
    whole = found.join(large.select("component").distinct(), "component", "left_anti")
    out = jobs.stored(whole.unionByName(components(stars)))
    jobs.drop(large, posted, stars)
    return out


def verified(sets: DataFrame, candidates: DataFrame, nodes: DataFrame, apart: bool = False) -> DataFrame:
    """(node, component) by the links on full sets, within the components (node, component) of
    the candidates."""
    found = candidates.join(nodes.select("node", "n"), "node")
    size = found.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    whole = (F.col("members") <= GROUP) & (F.col("shingles") <= GROUP_SHINGLES)
    rows = found.drop("n").join(size.select("component", whole.alias("whole"), _blocks().alias("blocks")), "component")
    rows = jobs.stored(rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    if not apart and not rows.where(F.col("blocks") > CROSSED).isEmpty():
        jobs.drop(rows)
        return verified(sets, refined(sets, candidates, nodes), nodes, apart=True)
    links = jobs.stored(_by_key(rows.where("whole").select("node", F.col("component").alias("key")).join(sets, "node"), _verify))
    large = rows.where("NOT whole")
    if large.isEmpty():
        out = components(links)
        jobs.drop(rows, links)
        return out
    # Each block with the next one.
    chain = F.array_distinct(F.array(F.greatest(F.col("block") - 1, F.lit(0)), F.least("block", F.col("blocks") - 2)))
    pairs = large.select("node", "component", F.explode(chain).alias("b")).select("node", F.xxhash64("component", "b").alias("key"))
    chained = jobs.stored(_by_key(pairs.join(sets, "node"), _verify))
    own = components(chained)
    large = large.join(own.withColumnRenamed("component", "own"), "node", "left").withColumn("own", F.coalesce("own", "node"))
    top = large.groupBy("component", "own").agg(F.count("*").alias("k")).groupBy("component").agg(F.max(F.struct("k", "own")).alias("top"), F.sum("k").alias("members"))
    top = top.select("component", F.col("top.own").alias("top"), (F.col("members") - F.col("top.k")).alias("outside"))
    large = large.join(top.where("outside > 0"), "component").withColumn("outer", F.col("own") != F.col("top"))
    large = jobs.stored(large.withColumn("outers", F.greatest(F.lit(1), F.ceil(F.col("outside") / (GROUP // 2)).cast("int"))))
    outer = large.where("outer").withColumn("a", F.pmod(F.xxhash64("node", F.lit(1)), F.col("outers"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    all_ = large.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("outers") - 1))).withColumn("b", F.col("block"))
    pick = lambda rows, outer: rows.select("node", "own", F.lit(outer).alias("outer"), F.xxhash64("component", F.col("a").cast("int"), F.col("b").cast("int")).alias("key"))
    crossed = jobs.stored(_by_key(pick(outer, True).unionByName(pick(all_, False)).join(sets, "node"), _verify_outer, "own", "outer"))
    out = components(links.unionByName(chained).unionByName(crossed))
    jobs.drop(rows, links, chained, own, large, crossed)
    return out


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, x, n, component) of every row; the component is null for an empty set."""
    signed = jobs.stored(signatures(docs))
    nodes = classes(signed)
    edges = candidate_edges(docs, nodes)
    found = components(edges)
    sets = jobs.stored(sets_of(docs, found.select("node").join(nodes, "node").select("node", "id", "n", "d1", "d2")))
    links = verified(sets, found, nodes)
    jobs.drop(edges, found, sets)
    of = nodes.select("node", "n", "d1", "d2").join(links, "node", "left").select("n", "d1", "d2", F.coalesce("component", "node").alias("component"))
    out = jobs.stored(signed.select("doc_id", "x", "n", "d1", "d2").join(of, ["n", "d1", "d2"], "left").select("doc_id", "x", "n", "component"))
    jobs.drop(signed, nodes, links)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    rows = labelled(docs)
    least = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    rows = rows.join(least, "component", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, with their columns, less all but one of each component: the row of the
    least id, null last, and the least text hash. Rows of empty sets all stay."""
    rows = labelled(docs)
    none, doc_id, x = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("x")
    first = rows.where("n > 0").groupBy("component").agg(F.min(F.struct(none.alias("none"), doc_id.alias("id"), x.alias("x"))).alias("s"))
    chosen = jobs.stored(first.select(F.col("s.none").alias("__none"), F.col("s.id").alias("__id"), F.col("s.x").alias("__x")))
    jobs.drop(rows)
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    keys = {"__none": doc_id.isNull(), "__id": F.coalesce(doc_id.cast("long"), F.lit(0)), "__x": F.xxhash64(text)}
    rows = jobs.numbered(docs)
    full = F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # Rows of the same id and text are one choice.
    order = Window.partitionBy(*keys).orderBy(F.lit(0))
    kept = rows.where(full).withColumns(keys).join(chosen, list(keys), "left_semi").withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r", *keys)
    return kept.unionByName(rows.where(~full)).toDF(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    jobs.prepare(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws
  from documents
),
s as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as x
  from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) as i from w)
),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all
),
linked as (
  select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)
),
edges as (select a, b from linked union all select b, a from linked),
reach(id, c) as (
  select doc_id, doc_id from documents union select e.b, r.c from reach r join edges e on e.a = r.id
),
least_ids as (select id, min(c) as c from reach group by id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c as component_id, d.doc_id = c as kept
from documents d left join n using (doc_id) join least_ids r on r.id = d.doc_id
"""
