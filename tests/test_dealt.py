"""Rows that become long texts and pages, or meet long chains of patterns, are dealt to all tasks before."""

import pytest
from pyspark.sql import functions as F

from cloakwork.functions.dialect import query
from cloakwork.sources import forms, profiles, shops, synthetic, tables

DATA = "/root/testdata/sf0.001"


def made_in(rows):
    """How many tasks make the rows."""
    return rows.select(F.spark_partition_id().alias("task")).distinct().count()


@pytest.mark.parametrize("source", [forms.pages, forms.all_pages, profiles.pages, shops.pages, query(lambda d: "select p_partkey from cloakwork_part", "part"), query(lambda d: "select page_id from cloakwork_pages", "pages")])
def test_one_file_is_the_work_of_all_tasks(spark, source):
    assert len(spark.read.parquet(f"{DATA}/customer.parquet").inputFiles()) == 1
    assert made_in(source(spark, DATA)) >= tables.parts(spark)


def test_customers_are_dealt_before_their_texts_are_made(spark):
    plan = synthetic.people(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aadhaar") < plan.rindex("RepartitionByExpression")


def test_pairs_and_fields_are_computed_once(spark):
    from cloakwork.functions.dialect import Spark
    from cloakwork.operators import act, goals
    from cloakwork.plans import acting

    assert goals.pairs(Spark(), "x").count("regexp_extract_all") == 2
    plan = acting.page_autofill(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 2 * len(act.VAULT)


def test_patterns_made_at_run_time_are_spared_where_the_word_is_not(spark):
    from cloakwork.functions.dialect import Spark

    test = Spark().word_in("w", "t")
    assert test.index("contains") < test.index("rlike")
    rows = spark.createDataFrame([("zoom", "join ZOOM now"), ("zoom", "zoomed"), ("a.b", "see A.B!"), ("a.b", "see axb"), ("K9", "my k9 here"), ("x", None)], "w string, t string")
    assert [r[0] for r in rows.selectExpr(test).collect()] == [True, False, True, False, True, None]
