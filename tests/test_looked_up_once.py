"""Names before chapters are looked up once for equal ones, and values of a row are worked out once."""

from pyspark.sql import functions as F

from lectern.operators import restoring
from lectern.plans import registry

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_case_is_worked_out_once(spark):
    df = spark.createDataFrame([("a @0@", "Читайте @0@", ["Первая книга Царств"])], "s string, t string, r array<string>")
    put = df.select(restoring.unprotect(F.col("s"), F.col("t"), F.col("r"), "ru").alias("x"))
    assert put.first().x == "Читайте Первую книгу Царств"
    assert plan(put).count("-ЯЁ-])(") <= 2


def test_chinese_names_meet_without_their_texts(spark):
    assert " _at#" not in plan(registry.QUERIES["citations_zh"](spark, DATA))

