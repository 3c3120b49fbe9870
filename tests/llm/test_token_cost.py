"""The cheap path of op10's tokens."""

from pyspark.sql import functions as F

from riskflow.llm import decontaminate


def test_tokens_that_stand_as_they_are(spark):
    text = "Plain words, (12 km) café x  50% -3 ... don't  y a1"
    row = spark.createDataFrame([(text,)], "t string").select(decontaminate.tokens(F.col("t")).alias("k")).first()
    words = ["Plain", "words", "12", "km", "café", "x", "50%", "-3", "don't", "y", "a1"]
    assert [k.word for k in row.k] == words
    one = spark.createDataFrame([(text,)], "t string").select(decontaminate.templates(decontaminate.tokens(F.col("t"))).alias("k"))
    assert one.first().k == [
        "plain", "words", "<number>", "<unit>", "café", "x", "<number>", "<number>", "don't", "y", "a1"
    ]
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan  # units are looked up, not compared one by one
