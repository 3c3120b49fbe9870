"""Encoders and coercions on the values where their rules differ."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskflow import contract as C
from riskflow.functions.coerce import coerce_label, coerce_numeric, parse_label
from riskflow.operators.columns import (
    BILINGUAL_SPEC,
    LENIENT_SPEC,
    SERVING_SPEC,
    TRAINING_SPEC,
    drop_columns,
    encode_survey,
    normalize_headers,
    require_columns,
    resolve_features,
)


def _one(spark, column, values, spec):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {column} string")
    rows = encode_survey(df, spec).orderBy("id").collect()
    return [r[column] for r in rows]


SLEEP = ["Less than 5 hours", "5-6 hours", "7-8 hours", "More than 8 hours", "Others", None,
         "LESS THAN 5 HOURS", "dưới 5 tiếng"]


def test_sleep_codes_differ_by_encoder(spark):
    assert _one(spark, "sleep_duration", SLEEP, TRAINING_SPEC) == [0, 1, 2, 3, 3, 3, 3, 3]
    assert _one(spark, "sleep_duration", SLEEP, BILINGUAL_SPEC) == [0, 1, 2, 3, 1, 1, 1, 1]
    assert _one(spark, "sleep_duration", SLEEP, SERVING_SPEC) == [0, 1, 2, 3, 1, 1, 1, 1]
    assert _one(spark, "sleep_duration", SLEEP, LENIENT_SPEC) == [0, 1, 2, 3, 1, 1, 0, 0]


def test_gender_codes_differ_by_encoder(spark):
    values = ["Male", "male", "nam", "Nam", "Nữ", "1", None]
    assert _one(spark, "gender", values, TRAINING_SPEC) == [1, 0, 0, 0, 0, 0, 0]
    assert _one(spark, "gender", values, BILINGUAL_SPEC) == [1, 0, 0, 1, 0, 0, 0]
    assert _one(spark, "gender", values, LENIENT_SPEC) == [1, 1, 1, 1, 0, 0, 0]
    assert _one(spark, "gender", values, SERVING_SPEC) == [1, 0, 0, 0, 0, 0, 0]


def test_family_codes_differ_by_encoder(spark):
    values = ["Yes", "yes", "1", "Có", "Không", "No", None]
    assert _one(spark, "family_history", values, TRAINING_SPEC) == [1, 0, 0, 0, 0, 0, 0]
    assert _one(spark, "family_history", values, BILINGUAL_SPEC) == [1, 0, 0, 1, 0, 0, 0]
    assert _one(spark, "family_history", values, LENIENT_SPEC) == [1, 1, 1, 1, 0, 0, 0]


def test_numbers_pass_through_the_tolerant_encoders(spark):
    df = spark.createDataFrame([(1, 2.0), (0, None)], "gender int, sleep_duration double")
    rows = encode_survey(df, LENIENT_SPEC).collect()
    assert [(r.gender, r.sleep_duration) for r in rows] == [(1.0, 2.0), (0.0, 1.0)]


def test_absent_columns_are_skipped(spark):
    df = spark.createDataFrame([("Male",)], "gender string")
    assert encode_survey(df, TRAINING_SPEC).columns == ["gender"]
    assert resolve_features(df) == ["gender"]
    with pytest.raises(ValueError, match="depression"):
        require_columns(df, ["depression"])


def test_headers_and_dropped_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["id", " City ", "Age "])
    assert normalize_headers(df).columns == ["id", "City", "Age"]
    assert drop_columns(normalize_headers(df)).columns == ["Age"]


def test_label_rules(spark):
    values = ["1", "Yes", "yes", "True", "true", "YES", "abc", "1.7", "-1.7", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, y string")
    rows = df.select(
        "id", parse_label(F.col("y"), C.TRUTHY_LABELS).alias("token"),
        coerce_label(F.col("y"), default=0).alias("number"),
        coerce_label(F.col("y")).alias("bare"),
    ).orderBy("id").collect()
    assert [r.token for r in rows] == [1, 1, 1, 1, 0, 0, 0, 0, 0, 0]
    assert [r.number for r in rows] == [1, 0, 0, 0, 0, 0, 0, 1, -1, 0]
    assert [r.bare for r in rows] == [1, None, None, None, None, None, None, 1, -1, None]


def test_numeric_rules(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string")
    got = df.select(
        coerce_numeric(F.col("v")).alias("a"), coerce_numeric(F.col("v"), default=20).alias("b")
    ).collect()
    assert [(r.a, r.b) for r in got] == [(1.5, 1.5), (None, 20.0), (None, 20.0)]
    with pytest.raises(PySparkException):
        df.select(coerce_numeric(F.col("v"), strict=True)).collect()
