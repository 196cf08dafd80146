"""Reading tables so that the work on them is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table of fewer files than there are cores is dealt out, as one file of one row
    group is one task however many cores wait."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def parts(spark: SparkSession) -> int:
    """To how many tasks rows are dealt: enough for all cores, also for those that come later."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table dealt out by its first column, before anything is made of its rows: a row of few bytes
    may become a page or a text of thousands, and Spark cuts files by their bytes alone. ``columns`` are those to read."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = parts(spark)
    rows = rows.select(*columns) if columns else rows
    return rows.repartition(n, rows.columns[0]) if len(rows.inputFiles()) < n else rows
