"""Spark helpers: bounded Arrow batches, tables that cut lineage, labelled samples."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_cloakwork_sent", False):
        return
    root = Path(__file__).resolve().parents[2]
    context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/cloakwork", "zip", root, "cloakwork"))
    context._cloakwork_sent = True


def prepare(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, bounds Arrow batches, whose rows can be very long texts, and lets Spark delete
    the shuffle files of a finished query, so that jobs of several queries need the disk
    of the largest only."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is named, and
    only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="cloakwork-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder at which nothing is yet."""
    return f"{shared_folder(spark)}/cloakwork-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them from there: lineage
    is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables whose successors are written."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def numbered(docs: DataFrame) -> DataFrame:
    """The columns by number: names with dots or backticks, and those that an operator uses
    within, are then no matter. ``toDF`` with the old names undoes it."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


#: A key of more than this part of the rows is hot. There are at most so many hot keys, whatever the table.
HOT_SHARE = 1000


def hot_join(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Left join of rows with a table of at most one row for each key; null joins null. A hot key's rows stay where
    they are and get its value by a broadcast of at most HOT_SHARE rows; the others are shuffled by key, where
    no key has more than one part in HOT_SHARE. Both tables are read several times: give stored ones."""
    values = values.withColumnRenamed(key, "__key")
    hot = rows.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n")).where(F.col("__n") * HOT_SHARE > rows.count()).drop("__n")
    hot = stored(hot)
    same, named = F.col(key).eqNullSafe(F.col("__key")), F.col(key).eqNullSafe(F.col("__hot"))
    chosen = hot.join(values, F.col("__hot").eqNullSafe(F.col("__key")), "left").drop("__key")
    warm = rows.join(F.broadcast(chosen), named).drop("__hot")
    cold = rows.join(F.broadcast(hot), named, "left_anti").join(values, same, "left").drop("__key")
    return warm.unionByName(cold)


def fold(doc_id):
    """crc32 of the id as text modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids outside fold 0, (doc_id, y): those of the least
    hashes, so a rerun gets the same. An id with several labels gets the greatest."""
    rows = labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
    rows = rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def with_labels(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents of a bounded labelled sample (doc_id, text, y)."""
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
