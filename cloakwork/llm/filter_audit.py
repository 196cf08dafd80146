"""Filter interaction audit by relations of failing ids.

Every filter has one stored table of the ids that fail it. Survivors of a set of filters are the ids
left by one anti-join after the other; as a prefix of an order is a set, the 2**k sets serve all k!
orders. What a filter removes after a prefix is a semi-join of the prefix's survivors with its failing
ids, with their labels; what is redundant, an anti-join of its failing ids with the survivors. Ids that
fail no filter survive every prefix and are only counted.

Each row of documents is a document of its own, also with a repeated or null id. A null text is an
empty one, a null lang the part ''. An id with several labels has the greatest; a null id has none, and
is neither a smaller id nor has one. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.llm import jobs

SPACES = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = "[#$%&*|]"
COPY = "E"


def conditions(text: Column, words: Column) -> dict[str, Column]:
    """What fails filters A to D, given a text and its words."""
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * MOST_CAPITALS,
        "D": text.rlike(SYMBOLS),
    }


def facts(docs: DataFrame, tests=conditions) -> DataFrame:
    """(rid, doc_id, part, digest, and a column for each test), stored: the only scan of the texts. ``rid`` is a
    number of the row, fixed as it is written."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    found = tests(F.col("text"), F.col("words"))
    return jobs.stored(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "part", F.unhex(F.md5("text")).alias("digest"), *(c.alias(name) for name, c in found.items())))


def copies(rows: DataFrame) -> DataFrame:
    """Rows whose text a smaller doc_id has too. The anti-join's key holds the id as well as the text's digest, so a
    text that a third of all rows share is spread like any other."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    return rows.where("doc_id is not null").join(first, ["digest", "doc_id"], "left_anti")


def failing_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """One stored table (rid, part) of failing ids for each filter."""
    names = [c for c in rows.columns if c not in ("rid", "doc_id", "part", "digest")]
    return {name: jobs.stored(rows.where(F.col(name)).select("rid", "part")) for name in names} | {COPY: jobs.stored(copies(rows).select("rid", "part"))}


def universe(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(rid, part, good, toxic) of all rows."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*((F.max(F.col(c).cast("int")) == 1).cast("int").alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    return rows.select("rid", "doc_id", "part").join(marks, "doc_id", "left").select("rid", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def survivors(ids: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """(rid, part, good, toxic, prefix): a row for each set of filters, as bits, that the id survives. Every step offers
    each row once without and once with the next filter, and the anti-join takes the latter from ids that fail it;
    all steps keep the ids where they are."""
    rows = ids.withColumn("prefix", F.lit(0))
    for k, table in enumerate(failing.values()):
        failed = table.select(F.col("rid").alias("failed"))
        rows = rows.withColumn("adds", F.explode(F.array(F.lit(False), F.lit(True)))).join(failed, (F.col("rid") == F.col("failed")) & F.col("adds"), "left_anti")
        rows = rows.select("rid", "part", "good", "toxic", (F.col("prefix") + F.when(F.col("adds"), 1 << k).otherwise(0)).alias("prefix"))
    return rows


def tallies(ids: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """(kind, part, prefix, filter, n, good, toxic): kept rows of each prefix, and removed and redundant
    ones of each filter (its number) after it. Rows of no number are left out."""
    full = (1 << len(failing)) - 1
    failed = reduce(DataFrame.unionByName, (t.select(F.col("rid").alias("failed"), "part", F.lit(k).alias("filter")) for k, t in enumerate(failing.values())))
    clean = ids.join(failed.select("failed"), F.col("rid") == F.col("failed"), "left_anti").groupBy("part").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    clean = clean.withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit(full))))
    dirty = ids.join(failed.select("failed"), F.col("rid") == F.col("failed"), "left_semi")
    alive = jobs.stored(survivors(dirty, failing))
    kept = alive.groupBy("part", "prefix").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).unionByName(clean)
    outside = lambda prefix, k: F.pmod(F.shiftright(prefix, k), F.lit(2)) == 0
    # Both sides are dealt by id alone; the difference keeps the filter and the prefix out of the join's keys.
    placed = alive.repartition("rid")
    asked = placed.withColumn("asked", F.explode(F.array(*(F.when(outside(F.col("prefix"), k), k) for k in range(len(failing)))))).where("asked is not null")
    removed = asked.join(failed.repartition("failed"), (F.col("rid") == F.col("failed")) & (F.col("asked") - F.col("filter") == 0), "left_semi")
    removed = removed.groupBy("part", "prefix", F.col("asked").alias("filter")).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    prefixes = F.array(*(F.array(*(F.lit(s) for s in range(full + 1) if not s >> k & 1)) for k in range(len(failing))))
    offered = failed.repartition("failed").withColumn("before", F.explode(F.get(prefixes, F.col("filter"))))
    redundant = offered.join(placed.select("rid", "prefix"), (F.col("rid") == F.col("failed")) & (F.col("before") - F.col("prefix") == 0), "left_anti")
    redundant = redundant.groupBy("part", F.col("before").alias("prefix"), "filter").agg(F.count("*").alias("n"))
    shape = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "part", "prefix", *(F.col(c) if c in rows.columns else F.lit(-1 if c == "filter" else 0).cast("int" if c == "filter" else "long").alias(c) for c in ("filter", "n", "good", "toxic")))
    return shape(kept, "kept").unionByName(shape(removed, "removed")).unionByName(shape(redundant, "redundant"))


def orders(names: list[str]) -> Column:
    """Every order and step: its filter's number, and the sets before it, after it and of all other filters."""
    rows, full = [], (1 << len(names)) - 1
    for order in permutations(range(len(names))):
        before = 0
        for step, k in enumerate(order, 1):
            cells = {"filter_order": "".join(names[i] for i in order), "step": step, "filter": k, "before": before, "after": before | 1 << k, "others": full ^ 1 << k}
            rows.append(F.struct(*(F.lit(v).alias(n) for n, v in cells.items())))
            before |= 1 << k
    return F.array(*rows)


def report(parts: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """One row for each part, order and step, zeros included. The tallies of a part are looked up in one map, which
    has at most k * 2**k + 2**k entries for k filters."""
    key = lambda kind, prefix, k: F.concat_ws(":", kind, prefix.cast("string"), k.cast("string"))
    sums = counts.groupBy("kind", "part", "prefix", "filter").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    entry = F.struct(key(F.col("kind"), F.col("prefix"), F.col("filter")), F.struct("n", "good", "toxic"))
    rows = parts.join(sums.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("counts")), "part").select("part", "counts", F.explode(orders(names)).alias("o"))
    found = lambda kind, prefix, k, what="n": F.coalesce(F.try_element_at("counts", key(F.lit(kind), F.col(prefix), k))[what], F.lit(0).cast("long"))
    k = F.col("o.filter")
    columns = {
        "kept": found("kept", "o.after", F.lit(-1)),
        "removed": found("removed", "o.before", k),
        "redundant": found("redundant", "o.before", k),
        "unique_fails": found("removed", "o.others", k),
        "good_lost": found("removed", "o.before", k, "good"),
        "toxic_lost": found("removed", "o.before", k, "toxic"),
    }
    rows = rows.select("part", "o.filter_order", "o.step", k.alias("filter"), *(c.alias(n) for n, c in columns.items()))
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame, tests=conditions) -> DataFrame:
    """What filters remove, repeat and lose in every order and at every step, by part. ``tests`` gives the conditions
    by names of one letter; COPY is added. Six filters have 720 orders: keep to so many."""
    rows = facts(docs, tests)
    failing = failing_tables(rows)
    ids = jobs.stored(universe(rows, labels))
    return report(ids.select("part").distinct(), tallies(ids, failing), [*failing])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs.prepare(spark)
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_WORDS = "list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

#: Sets of failed filters as bits, counted by part, in place of joins.
SQL = f"""with d as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part from documents),
    w as (select *, {_WORDS} as ws, min(doc_id) over (partition by text) as first_id from d),
    m as (select w.doc_id, part, case when len(ws) < 200 then 1 else 0 end + case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end
      + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 4 else 0 end + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
      + case when w.doc_id > first_id then 16 else 0 end as fails, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic
      from w left join (select doc_id, cast(max(quality) = 1 as int) as good, cast(max(toxic) = 1 as int) as toxic from labels group by 1) l on l.doc_id = w.doc_id),
    c as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
    f as (select unnest(['A', 'B', 'C', 'D', 'E']) as l, unnest([1, 2, 4, 8, 16]) as b),
    o as (select a.l || b.l || c.l || d.l || e.l as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits from f a, f b, f c, f d, f e
      where a.b + b.b + c.b + d.b + e.b = 31 and a.b <> b.b and a.b <> c.b and a.b <> d.b and a.b <> e.b and b.b <> c.b and b.b <> d.b and b.b <> e.b and c.b <> d.b and c.b <> e.b and d.b <> e.b),
    s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, (select unnest(generate_series(1, 5)) as step) t),
    r as (select part, filter_order, cast(step as int) as step, bit,
      sum(case when fails & (before | bit) = 0 then n else 0 end) as kept, sum(case when fails & bit > 0 and fails & before = 0 then n else 0 end) as removed,
      sum(case when fails & bit > 0 and fails & before > 0 then n else 0 end) as redundant, sum(case when fails = bit then n else 0 end) as unique_fails,
      sum(case when fails & bit > 0 and fails & before = 0 then good else 0 end) as good_lost, sum(case when fails & bit > 0 and fails & before = 0 then toxic else 0 end) as toxic_lost
      from s, c group by all)
    select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
      (sum(removed) over (partition by part, bit))::bigint as shapley from r"""
