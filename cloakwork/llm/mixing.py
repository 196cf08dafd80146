"""Mixing sources to target weights: a reproducible mix of fixed-length blocks.

The words of a source, its documents in an order by hash, form one stream that is cut into
blocks of BLOCK words. The mix is a row of slots, a block each, cut into shards of SHARD
slots. How many slots of a shard each source gets is a multinomial draw by the targets,
seeded by the shard's number, so no shard waits for another. Sums over the shards before,
by runs of RUN shards, number the slots of a source. Slots past a source's target stay
free, and what a source still lacks after the last draw follows in closing shards.
Slot k of a source reads block ``permutation(k)``, a keyed bijection of the block numbers,
a new one for each pass over the source; blocks are then joined by number. The last slot of
a source is cut to the words still owed, so that the words taken equal the target rounded
to a whole number, and no block is read more often than twice.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating; they share 150% of
all words; a target stops at twice its source's words, and the excess is shared again by
weight among the others until none is above.

Defined results: a document without words is in the mix with 0 words taken; rows that are
equal are documents of their own, and both are taken; null and empty ids and sources are
values like others; sources without words get the target 0; an empty table gives no rows;
extra columns are ignored by the mix. The order of a source's documents is by BUCKETS ranges
of their hashes, whatever the session's settings. A few numbers for each source reach the
driver and every task: sources are named by who weighs them, thousands at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.llm import jobs, textops

WEIGHTS, SHARE, LIMIT = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK, SHARD, RUN = 256, 256, 1024
BUCKETS = 4096
STRIDE = 157  # prime to SHARD
SEED = 20_240_607


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Words wanted of each source, in the order of the sources."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))])
    size = np.array(sizes, float)
    out, open_ = np.zeros(len(size)), size > 0
    left = share * size.sum()
    out[~open_] = 0.0
    while open_.any():
        want = left * w / w[open_].sum()
        above = open_ & (want > limit * size)
        if not above.any():
            out[open_] = want[open_]
            break
        out[above] = limit * size[above]
        left -= out[above].sum()
        open_ &= ~above
    return out.tolist()


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), "text").alias("row"), "text")


def count_words(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row, size): ``row`` is a hash of the id, source and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textops.chunks(batch.column(3)):
                own = batch.slice(chunk.first_row, chunk.rows)
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(chunk.words().counts, pa.int64())], ["doc_id", "source", "row", "size"])

    return keyed(docs).mapInArrow(run, "doc_id long, source string, row long, size long")


def with_offsets(sized: DataFrame) -> DataFrame:
    """Adds ``at``, the words of the source before the document, and the bucket that a
    source is cut into so that no source meets in one task."""
    rows = sized.withColumn("bucket", F.pmod("row", F.lit(BUCKETS)).cast("int"))
    own = Window.partitionBy("source", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(own), F.lit(0)))
    base = base.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), F.col("bucket").alias("b"), "base")
    joined = rows.join(base, (F.coalesce("source", F.lit("")) == F.col("s")) & (F.col("source").isNull() == F.col("none")) & (F.col("bucket") == F.col("b")))
    return joined.withColumn("at", F.col("at") + F.col("base")).drop("s", "none", "b", "base", "bucket")


class Plan:
    """What a mix of sources of these sizes is made of; a few numbers for each source."""

    def __init__(self, names: list, sizes: list[int], seed: int = SEED):
        self.names, self.sizes, self.seed = names, sizes, seed
        self.targets = targets(sizes)
        self.blocks = [-(-n // BLOCK) for n in sizes]
        #: Whole passes read every block; a part of a pass ends when the words owed are met.
        self.slots = [self._slots(t, n) for t, n in zip(self.targets, sizes, strict=True)]
        self.shards = -(-sum(self.slots) // SHARD)

    def _slots(self, target: float, size: int) -> int:
        passes, left = divmod(round(target), size) if size else (0, 0)
        return passes * -(-size // BLOCK) + -(-left // BLOCK) + (1 if left and size % BLOCK else 0)

    def draw(self, shard: int) -> np.ndarray:
        """The slots of each source in a shard."""
        total = sum(self.slots)
        rng = np.random.default_rng([self.seed, shard])
        return rng.multinomial(min(SHARD, total - shard * SHARD), np.array(self.slots) / total)

    def closing(self, drawn: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
        """(shard, s, before, first, n): what the sources lack after all draws."""
        out, at = [], self.shards * SHARD
        for s, wanted in enumerate(self.slots):
            k = drawn.get(s, 0)
            while k < wanted:
                n = min(wanted - k, SHARD - at % SHARD)
                out.append((at // SHARD, s, at % SHARD, k, n))
                k, at = k + n, at + n
        return out

    def permutation(self, source: int, k: np.ndarray) -> np.ndarray:
        """Block numbers of the source's slots: a bijection of each pass by a Feistel
        network over the next even power of two, walked until the number is in range. The
        last block, if it is short, is kept out of no pass."""
        n = self.blocks[source]
        bits = max(1, -(-(max(n - 1, 1)).bit_length() // 2))
        mask = np.uint64((1 << bits) - 1)
        epoch, x = np.divmod(k.astype(np.uint64), np.uint64(n))
        out, todo = x.copy(), np.ones(len(k), bool)
        while todo.any():
            left, right = out[todo] >> np.uint64(bits), out[todo] & mask
            for r in range(4):
                key = textops.mix(right + epoch[todo] * np.uint64(0x1F123BB5), self.seed + 31 * source + r)
                left, right = right, left ^ (key & mask)
            out[todo] = left << np.uint64(bits) | right
            todo = out >= n
        return out.astype(np.int64)


def plan_for(sized: DataFrame, seed: int = SEED) -> Plan:
    """Sources by code point, null last; one row for each source reaches the driver."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    return Plan([r["source"] for r in rows], [r["n"] for r in rows], seed)


def shard_counts(spark, plan: Plan) -> DataFrame:
    """(shard, s, before, first, n): the source's slots in a shard, which begin at ``before`` in
    the shard and at ``first`` in the source."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                n = plan.draw(int(shard))
                own = np.flatnonzero(n)
                yield pd.DataFrame({"shard": int(shard), "s": own, "before": (np.cumsum(n) - n)[own], "n": n[own]})

    parts = max(1, min(plan.shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    drawn = jobs.stored(spark.range(0, plan.shards, 1, parts).mapInPandas(run, "shard long, s int, before long, n long").withColumn("run", F.floor(F.col("shard") / RUN)))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = drawn.groupBy("s", "run").agg(F.sum("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(before("s", "run")), F.lit(0)))
    rows = drawn.join(runs.drop("m"), ["s", "run"]).withColumn("first", F.col("base") + F.coalesce(F.sum("n").over(before("s", "run", "shard")), F.lit(0)))
    wanted = spark.createDataFrame(list(enumerate(plan.slots)), "s int, wanted long")
    rows = rows.join(F.broadcast(wanted), "s").withColumn("n", F.least("n", F.col("wanted") - F.col("first"))).where("n > 0")
    totals = {r["s"]: r["n"] for r in drawn.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    return rows.select("shard", "s", "before", "first", "n").unionByName(spark.createDataFrame(plan.closing(totals), "shard long, s int, before long, first long, n long"))


def slots(spark, plan: Plan) -> DataFrame:
    """(shard, slot, s, k, block): every slot of the mix; s is the source's number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = frame["n"].to_numpy()
            each = lambda c: np.repeat(frame[c].to_numpy(), n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s, k, block = each("s"), each("first") + j, np.zeros(n.sum(), np.int64)
            for i in np.unique(s):
                block[s == i] = plan.permutation(int(i), k[s == i])
            yield pd.DataFrame({"shard": each("shard"), "slot": each("before") + j, "s": s, "k": k, "block": block})

    rows = shard_counts(spark, plan).mapInPandas(run, "shard long, slot long, s int, k long, block long")
    # Within a shard the slots of all sources are shuffled, by a bijection of its places.
    return rows.withColumn("slot", F.pmod(F.col("slot") * STRIDE + F.xxhash64(F.lit(plan.seed), "shard"), F.lit(SHARD)))


def owed(rows: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``words``, how many of its block a slot takes: the slots of a part of a pass,
    in order, take whole blocks until the words owed are met. Only one block of a source
    is short, so a slot's first word follows from its number and that block's place."""
    spark = rows.sparkSession
    facts = []
    for s, (size, blocks, target) in enumerate(zip(plan.sizes, plan.blocks, plan.targets, strict=True)):
        short = blocks * BLOCK - size
        # The slot of each pass that reads the short block, and what is owed in all.
        places = [_place(plan, s, p, blocks) if short else -1 for p in range(2)] if size else [-1, -1]
        facts.append((s, size, blocks, short, round(target), *places))
    table = spark.createDataFrame(facts, "s int, size long, blocks long, short long, target long, p0 long, p1 long")
    joined = rows.join(F.broadcast(table), "s")
    k, n = F.col("k"), F.col("blocks")
    lost = lambda p, at: F.when((F.col(p) >= 0) & (at > F.col(p)), F.col("short")).otherwise(F.lit(0))
    begin = k * BLOCK - lost("p0", k) - lost("p1", k)
    own = F.when(F.col("block") == n - 1, BLOCK - F.col("short")).otherwise(F.lit(BLOCK))
    words = F.least(own, F.greatest(F.lit(0), F.col("target") - begin))
    return joined.withColumn("words", words.cast("long")).drop("size", "blocks", "short", "target", "p0", "p1")


def _place(plan: Plan, s: int, epoch: int, blocks: int) -> int:
    """The slot of a pass that reads the last block, found by stepping the permutation's
    inverse: the network run backwards from it."""
    bits = max(1, -(-(max(blocks - 1, 1)).bit_length() // 2))
    mask = (1 << bits) - 1
    x = blocks - 1
    while True:
        left, right = x >> bits, x & mask
        for r in reversed(range(4)):
            key = int(textops.mix(np.array([left], np.uint64) + np.uint64(epoch) * np.uint64(0x1F123BB5), plan.seed + 31 * s + r)[0])
            left, right = right ^ (key & mask), left
        x = left << bits | right
        if x < blocks:
            return epoch * blocks + x


def mix(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame, Plan]:
    """(documents with their offsets, slots with words, plan)."""
    sized = jobs.stored(count_words(docs))
    plan = plan_for(sized, seed)
    return with_offsets(sized), owed(slots(docs.sparkSession, plan), plan).where("words > 0"), plan


def numbered(rows: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``s``, the number of the source, its words and its target."""
    facts = [(i, name, name is None, n, t) for i, (name, n, t) in enumerate(zip(plan.names, plan.sizes, plan.targets, strict=True))]
    table = rows.sparkSession.createDataFrame(facts, "s int, name string, none boolean, source_size long, target double")
    table = table.withColumn("name", F.coalesce("name", F.lit("")))
    return rows.join(F.broadcast(table), (F.coalesce("source", F.lit("")) == F.col("name")) & (F.col("source").isNull() == F.col("none"))).drop("name", "none")


def taken(placed: DataFrame, mixed: DataFrame, plan: Plan) -> DataFrame:
    """Each document with the words that the mix takes of it, repeats counted: its part
    of every block joined with the block's slots."""
    rows = numbered(placed, plan)
    at, end = F.col("at"), F.col("at") + F.col("size")
    parts = rows.where("size > 0").select("s", "row", "doc_id", at.alias("at"), end.alias("end"), F.explode(F.sequence(F.floor(at / BLOCK), F.floor((end - 1) / BLOCK))).alias("block"))
    # Whole slots of a block are counted; of each cut one the number of words is kept.
    reads = mixed.groupBy("s", "block").agg(F.collect_list("words").alias("reads"))
    start = F.greatest(F.col("at") - F.col("block") * BLOCK, F.lit(0))
    stop = F.least(F.col("end") - F.col("block") * BLOCK, F.lit(BLOCK))
    got = F.aggregate("reads", F.lit(0).cast("long"), lambda a, n: a + F.greatest(F.least(stop, n) - start, F.lit(0)))
    sums = parts.join(reads, ["s", "block"]).groupBy("row", F.coalesce("doc_id", F.lit(0)).alias("d"), "at").agg(F.sum(got).alias("taken"))
    return rows.withColumn("d", F.coalesce("doc_id", F.lit(0))).join(sums, ["row", "d", "at"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def op1(spark, sf_dir: str) -> DataFrame:
    jobs.prepare(spark)
    placed, mixed, plan = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken(placed, mixed, plan)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block takes of each document."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("s", "block", "start", "piece")}
        size = 0
        for s, at, text in zip(batch.column("s").to_pylist(), batch.column("at").to_pylist(), batch.column("text"), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            done = 0
            while done < len(words):
                start = (at + done) % BLOCK
                own = words[done : done + BLOCK - start]
                for k, v in zip(out, (s, (at + done) // BLOCK, start, b" ".join(own)), strict=True):
                    out[k].append(v)
                done += len(own)
                size += 1
                if size >= 4096:
                    yield _piece_rows(out)
                    out, size = {k: [] for k in out}, 0
        if size:
            yield _piece_rows(out)


def _piece_rows(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out["s"], pa.int32()), pa.array(out["block"], pa.int64()), pa.array(out["start"], pa.int64()), pa.array(out["piece"], pa.binary()).cast(pa.string())], list(out))


def assemble(docs: DataFrame, placed: DataFrame, mixed: DataFrame, plan: Plan) -> DataFrame:
    """(shard, slot, source, block, n_words, text): the mix itself, a row for each slot; words
    are joined by one space. Blocks are made once and joined with their slots by number."""
    rows = numbered(placed, plan).where("size > 0").select("s", "row", "at")
    texts = keyed(docs).select("row", "text").dropDuplicates(["row"])
    pieces = rows.join(texts, "row").select("s", "at", "text").mapInArrow(_pieces, "s int, block long, start long, piece string")
    blocks = pieces.groupBy("s", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), " ").alias("text"))
    names = docs.sparkSession.createDataFrame(list(enumerate(plan.names)), "s int, source string")
    out = mixed.join(blocks, ["s", "block"]).join(F.broadcast(names), "s")
    return out.select("shard", "slot", "source", "block", F.col("words").alias("n_words"), F.when(F.col("words") == BLOCK, F.col("text")).otherwise(F.array_join(F.slice(F.split("text", " "), 1, F.col("words").cast("int")), " ")).alias("text"))
