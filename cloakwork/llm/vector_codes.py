"""Vector code compression by dual-tree Lloyd.

Vectors become integers and are cut into equal parts; each part position has a codebook of ENTRIES entries
that starts as the parts of the least vec_ids. A round assigns every part to its nearest entry and moves the
entries to their parts' floored means.

A task takes its vectors in blocks. For each position it builds a tree over the block's parts, whose nodes
have a bounding box, a sum and a number of parts, and walks it from the root down together with a tree over the
entries. A pair of nodes goes on only while the least distance of its boxes is no more than the
least of the greatest distances that the node's pairs have; then the pair's children meet. Where one entry is left,
all of the node's parts are its own: the node's sum is added as it is. Leaves with several entries left
compare integers. Bounds and distances are exact integers, and a pair of equal bounds goes on, so the
result is that of comparing everything, with ties to the lower index.

A task emits a sum for each position and entry, so what is shuffled and what the driver holds, 16 * 64
entries, doesn't grow with the table.

Vectors that are null, empty or hold null or non-finite components go. The vector of the least vec_id (null
last) gives the length; vectors of another one go too. A length that the positions don't divide is filled
up with zeros. A repeated vec_id starts one entry, by its least vector; each of its rows has a code.
With fewer ids than entries codebooks are smaller. An empty table gives no rows. Components of up to 2**84 are
exact; an error over 2**63 - 1 is given as that. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import jobs

POSITIONS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors and components of a block at most, and parts of a leaf of its tree.
BLOCK, BLOCK_COMPONENTS, LEAF = 4096, 1 << 20, 8
LONGEST = (1 << 63) - 1
#: Components under this are compared in int64: squares of their differences add up to less than 2**63 over 2**11 components.
SAFE = 1 << 25


def integers(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of usable vectors their rows and integers, as an array of int64 or, for great components,
    of Python's integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    n, offsets = len(column), column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    size = np.diff(offsets)
    usable = (size > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    if column.null_count:
        usable &= column.is_valid().to_numpy(zero_copy_only=False)
    out = {}
    for length in np.unique(size[usable]):
        rows = np.flatnonzero(usable & (size == length))
        values = np.floor(flat[offsets[rows][:, None] + np.arange(length)] * SCALE)
        small = np.abs(values).max() < SAFE
        out[int(length)] = rows, values.astype(np.int64) if small else np.array([[int(v) for v in r] for r in values], object)
    return out


def parts(vectors: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """(position, vector, component)."""
    n, length = vectors.shape
    width = -(-length // positions)
    if width * positions != length:
        vectors = np.concatenate([vectors, np.zeros((n, width * positions - length), vectors.dtype)], axis=1)
    return np.ascontiguousarray(vectors.reshape(n, positions, width).transpose(1, 0, 2))


class Tree:
    """A balanced tree over points: every level halves its nodes at the median of their widest side. Points are
    filled up to a power of two with copies of the last that count for nothing."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        n, width = points.shape
        leaves = 1 << max(0, (-(-n // leaf) - 1).bit_length())
        total = leaves * leaf
        at = np.minimum(np.arange(total), n - 1)
        real = (np.arange(total) < n).astype(np.int64)
        order = np.arange(total)
        nodes = 1
        while nodes < leaves:
            held = points[at[order]].reshape(nodes, total // nodes, width)
            side = (held.max(axis=1) - held.min(axis=1)).argmax(axis=1)
            key = np.take_along_axis(held, side[:, None, None], axis=2)[:, :, 0]
            half = np.argpartition(key, total // nodes // 2, axis=1)
            order = np.take_along_axis(order.reshape(nodes, -1), half, axis=1).ravel()
            nodes *= 2
        self.points, self.index, self.weight = points[at[order]].reshape(leaves, leaf, width), at[order].reshape(leaves, leaf), real[order].reshape(leaves, leaf)
        low, high = self.points.min(axis=1), self.points.max(axis=1)
        total_of, count = (self.points * self.weight[:, :, None]).sum(axis=1), self.weight.sum(axis=1)
        #: From the root's level to the leaves': boxes, sums and numbers of the nodes.
        self.levels = [(low, high, total_of, count)]
        while len(low) > 1:
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            total_of, count = total_of[::2] + total_of[1::2], count[::2] + count[1::2]
            self.levels.append((low, high, total_of, count))
        self.levels.reverse()


def assign(points: np.ndarray, entries: np.ndarray, book: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the points of one position: sums and numbers by entry, and each point's entry. ``book`` is the tree over
    the entries with one entry in a leaf."""
    tree, k = Tree(points, LEAF), len(entries)
    sums, counts = np.zeros((k, points.shape[1]), entries.dtype), np.zeros(k, np.int64)
    code = np.zeros(len(points), np.int64)
    leaves, depth, deep = len(tree.points), len(tree.levels) - 1, len(book.levels) - 1
    node, entry, level, below = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while True:
        low, high, total, count = (x[node] for x in tree.levels[level])
        e_low, e_high = (x[entry] for x in book.levels[below][:2])
        gap = np.maximum(np.maximum(low - e_high, e_low - high), 0)
        reach = np.maximum(high - e_low, e_high - low)
        least, most = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        bound = np.minimum.reduceat(most, first)
        which = np.cumsum(np.concatenate([[True], node[1:] != node[:-1]])) - 1
        kept = least <= bound[which]
        node, entry = node[kept], entry[kept]
        if below == deep:
            alone = np.concatenate([[True], node[1:] != node[:-1]]) & np.concatenate([node[1:] != node[:-1], [True]])
            own, its = node[alone], book.index[entry[alone], 0]
            np.add.at(sums, its, tree.levels[level][2][own])
            np.add.at(counts, its, tree.levels[level][3][own])
            width = leaves >> level
            spread = (own[:, None] * width + np.arange(width)).ravel()
            code[tree.index[spread].ravel()] = np.repeat(its, width * LEAF)
            node, entry = node[~alone], entry[~alone]
        if not len(node) or (level == depth and below == deep):
            break
        if level < depth:
            # Both children of a node meet all that the node met; the order by node stays.
            node, entry = np.concatenate([node * 2, node * 2 + 1]), np.concatenate([entry, entry])
            order = np.argsort(node, kind="stable")
            node, entry, level = node[order], entry[order], level + 1
        if below < deep:
            # So do an entry node's; what only fills up the tree is left out.
            entry, node = np.stack([entry * 2, entry * 2 + 1], axis=1).ravel(), np.repeat(node, 2)
            real = book.levels[below + 1][3][entry] > 0
            node, entry, below = node[real], entry[real], below + 1
    if len(node):
        _compare(tree, entries, book.index[entry, 0], node, sums, counts, code)
    return sums, counts, code


def _compare(tree: Tree, entries: np.ndarray, entry: np.ndarray, node: np.ndarray, sums: np.ndarray, counts: np.ndarray, code: np.ndarray) -> None:
    """Compares the points of leaves with the entries that are left to them, in integers."""
    order = np.lexsort((entry, node))
    node, entry = node[order], entry[order]
    away = np.zeros((len(node), tree.points.shape[1]), entries.dtype)
    for c in range(entries.shape[1]):
        step = tree.points[:, :, c][node] - entries[entry, c][:, None]
        away += step * step
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    best = np.minimum.reduceat(away, first, axis=0)
    which = np.cumsum(np.concatenate([[True], node[1:] != node[:-1]])) - 1
    # Entries are in order, so the least index of those at the least distance is the first one.
    chosen = np.minimum.reduceat(np.where(away == best[which], entry[:, None], len(entries)), first, axis=0)
    leaf = node[first]
    weight, index = tree.weight[leaf], tree.index[leaf]
    np.add.at(sums, chosen.ravel(), (tree.points[leaf] * weight[:, :, None]).reshape(-1, entries.shape[1]))
    np.add.at(counts, chosen.ravel(), weight.ravel())
    code[index.ravel()] = chosen.ravel()


class Codebooks:
    """(position, entry, component) of integers."""

    def __init__(self, entries: np.ndarray, length: int) -> None:
        self.entries, self.length = entries, length

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.entries.ravel()).encode()).hexdigest()

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[tuple[np.ndarray, np.ndarray, Tree]]]]:
        """The usable rows by blocks of some thousands: their other columns, their vectors, and for each position
        the parts, the entries and the tree over these. ``embedding`` is the last column."""
        held, size, books = [], 0, {}

        def block():
            vectors = np.concatenate([v for _, v in held])
            dtype = np.dtype(object) if self.entries.dtype == object else vectors.dtype
            if dtype not in books:
                books[dtype] = [(e, Tree(e, 1)) for e in self.entries.astype(dtype)]
            vectors = vectors.astype(dtype)
            return pa.concat_batches([r for r, _ in held]), vectors, [(x, *book) for x, book in zip(parts(vectors, len(self.entries)), books[dtype], strict=True)]

        most = max(1, min(BLOCK, BLOCK_COMPONENTS // self.length))
        for batch in batches:
            rows, vectors = integers(batch.column(batch.num_columns - 1)).get(self.length, (np.empty(0, int), None))
            for i in range(0, len(rows), most):
                own = rows[i : i + most]
                held.append((batch.select(range(batch.num_columns - 1)).take(pa.array(own)), vectors[i : i + most]))
                size += len(own)
                if size >= most:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each position and entry that has parts: their number, and their sums as decimal text."""
        total, counts = np.zeros(self.entries.shape, object), np.zeros(self.entries.shape[:2], np.int64)
        for _, _, work in self.blocks(batches):
            for j, (points, entries, book) in enumerate(work):
                s, n, _ = assign(points, entries, book)
                total[j] += s.astype(object)
                counts[j] += n
        position, entry = np.nonzero(counts)
        rows = [[str(int(v)) for v in total[j, e]] for j, e in zip(position, entry, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(position.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[position, entry]), pa.array(rows, pa.list_(pa.string()))], ["position", "entry", "n", "sums"])

    def codes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(vec_id, label, code, error) of usable rows."""
        for rows, vectors, work in self.blocks(batches):
            code, error = np.empty((len(vectors), len(work)), np.uint8), np.zeros(len(vectors), vectors.dtype)
            for j, (points, entries, book) in enumerate(work):
                code[:, j] = assign(points, entries, book)[2]
                step = points - entries[code[:, j]]
                error += (step * step).sum(axis=1)
            held = pa.array([min(int(e), LONGEST) for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([c.tobytes().hex() for c in code]), held], ["vec_id", "label", "code", "error"])


def _seeds(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    """The task's least ids (null last), for each length, each with its least vector as text."""
    least: dict[int, dict] = {}
    for batch in batches:
        null, ids = batch.column(0).is_null().to_numpy(zero_copy_only=False), batch.column(0).fill_null(LONGEST).to_numpy()
        for length, (rows, vectors) in integers(batch.column(1)).items():
            own, keys = least.setdefault(length, {}), ids[rows]
            low = np.unique(keys)[:entries][-1]
            for at in np.flatnonzero(keys <= low):
                key, held = (bool(null[rows[at]]), int(keys[at])), tuple(map(int, vectors[at]))
                own[key] = min(own.get(key, held), held)
            for key in sorted(own)[entries:]:
                del own[key]
    rows = [(None if null else key, [str(x) for x in v]) for own in least.values() for (null, key), v in own.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["vec_id", "vector"])


def first_books(vectors: DataFrame, entries: int = ENTRIES) -> Codebooks | None:
    """Codebooks of the least vec_ids, of which the driver gets at most ``entries``; none without usable vectors."""
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(lambda b: _seeds(b, entries), "vec_id long, vector array<string>")
    found = found.withColumn("vector", F.transform("vector", lambda x: x.cast("decimal(38,0)")))
    found = found.groupBy("vec_id", F.size("vector").alias("length")).agg(F.min("vector").alias("vector"))
    first = found.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    if not first:
        return None
    length = first[0]["length"]
    rows = found.where(F.col("length") == length).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    return Codebooks(_narrow(parts(np.array([[int(x) for x in r["vector"]] for r in rows], object))), length)


def step(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: the entries moved to the floored means of their parts; unused ones stay."""
    width = books.entries.shape[2]
    sums = vectors.select("embedding").mapInArrow(books.sums, "position int, entry int, n long, sums array<string>")
    totals = sums.groupBy("position", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)))
    entries = books.entries.astype(object)
    for row in totals.collect():
        entries[row["position"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    return Codebooks(_narrow(entries), books.length)


def _narrow(entries: np.ndarray) -> np.ndarray:
    """As int64 where distances from such entries fit in it."""
    return entries.astype(np.int64) if all(abs(v) < SAFE for v in entries.ravel()) else entries


def fit(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> Codebooks | None:
    """Codebooks after the rounds, on all vectors."""
    books = first_books(vectors, entries)
    for _ in range(rounds if books else 0):
        books = step(vectors, books)
    return books


CODED = "vec_id long, label long, code string, error long"


def encode(vectors: DataFrame, books: Codebooks | None) -> DataFrame:
    """(vec_id, label, code, error) of every usable vector."""
    if books is None:
        return vectors.sparkSession.createDataFrame([], CODED)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").mapInArrow(books.codes, CODED)


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """Adds ``approximation``, the vector that the code stands for."""
    entries = (books.entries.astype(float) / SCALE).tolist()
    length = books.length

    def restored(code: pd.Series) -> pd.Series:
        return code.map(lambda c: [x for j, e in enumerate(bytes.fromhex(c)) for x in entries[j][e]][:length])

    return coded.withColumn("approximation", F.pandas_udf(restored, "array<double>")("code"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs.prepare(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = fit(vectors)
    coded = jobs.stored(encode(vectors, books))
    sums = jobs.stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    rows = jobs.hot_join(coded, sums, "label")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


def _round(k: int) -> str:
    """DuckDB's round: every part against every entry, then means."""
    return f"""r{k} as (select p.id, p.j, p.v, arg_min(b.e, [list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e]) as e from p join b{k} b on b.j = p.j group by p.id, p.j, p.v),
    m{k} as (select j, e, list(s order by i) as v from (select j, e, i, (sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*) as s from (select j, e, unnest(generate_series(1, len(v))) as i, unnest(v) as x from r{k}) u group by all) t group by all),
    b{k + 1} as (select b.j, b.e, coalesce(m{k}.v, b.v) as v from b{k} b left join m{k} on m{k}.j = b.j and m{k}.e = b.e)"""


SQL = f"""with kept as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    numbered as (select *, row_number() over (order by vec_id) - 1 as id from kept),
    p as (select id, j, q[j * len(q) // 16 + 1 : (j + 1) * len(q) // 16] as v from numbered, (select unnest(generate_series(0, 15)) as j) t),
    b0 as (select j, id as e, v from p where id < 64),
    {_round(0)}, {_round(1)},
    d as (select p.id, p.j, b.e, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as dist from p join b2 b on b.j = p.j),
    c as (select id, j, arg_min(e, [dist, e]) as e, min(dist) as dist from d group by all),
    o as (select id, string_agg(printf('%02x', e::int), '' order by j) as code, sum(dist)::bigint as error from c group by id),
    h as (select sha256(string_agg(x::varchar, ',' order by j, e, i)) as books from (select j, e, unnest(generate_series(1, len(v))) as i, unnest(v) as x from b2) t)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, books as codebooks_sha256 from o join numbered using (id), h"""
