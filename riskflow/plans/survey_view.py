"""A survey derived from the ``customer`` table, as one projection per step.

The expressions are plain SQL that Spark and other engines read alike; they also work on
a stream of customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MIX = {"h1": (48271, 69621), "h2": (39373, 48271), "h3": (69621, 39373),
        "h4": (16807, 69621), "h5": (40692, 48271)}

STEPS: list[list[str]] = [
    ["c_custkey AS id"]
    + [
        f"((c_custkey+1)*{a} % 2147483647)*{b} % 2147483647 AS {name}"
        for name, (a, b) in _MIX.items()
    ],
    ["id", "h2", "h3", "h4", "h5", "18 + h1 % 17 AS age",
     "CAST(500 + h2 % 501 AS DOUBLE) / 100 AS cgpa",
     "1 + h3 % 5 AS ap", "1 + h4 % 5 AS ss", "1 + h5 % 5 AS fs"],
    ["id",
     "CASE WHEN id % 53 = 0 THEN NULL WHEN h3 % 100 < 55 THEN 'Male' ELSE 'Female' END AS gender",
     "CASE WHEN id % 41 = 0 THEN NULL ELSE CAST(age AS DOUBLE) END AS age",
     "CASE WHEN id % 37 = 0 THEN NULL ELSE cgpa END AS cgpa",
     "CAST(ap AS DOUBLE) AS academic_pressure",
     "CAST(ss AS DOUBLE) AS study_satisfaction",
     "CASE WHEN id % 29 = 0 THEN NULL ELSE CAST(fs AS DOUBLE) END AS financial_stress",
     "CASE h4 % 23 % 6 WHEN 0 THEN 'Less than 5 hours' WHEN 1 THEN '5-6 hours' "
     "WHEN 2 THEN '7-8 hours' WHEN 3 THEN 'More than 8 hours' "
     "WHEN 4 THEN 'Others' ELSE NULL END AS sleep_duration",
     "CASE WHEN h5 % 100 < 48 THEN 'Yes' ELSE 'No' END AS family_history",
     "CASE WHEN 8*(ap-3) + 6*(fs-3) - 3*(ss-3) - (age-26) + h2 % 31 - 12 > 0 "
     "THEN 1 ELSE 0 END AS depression"],
]


def as_survey(customers: DataFrame) -> DataFrame:
    out = customers
    for step in STEPS:
        out = out.selectExpr(*step)
    return out


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_survey(spark.read.parquet(f"{sf_dir}/customer.parquet"))
