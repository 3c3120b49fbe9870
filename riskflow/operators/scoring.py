"""Scores from exported parameters: plain column arithmetic, for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.scalar import percent, risk_components, risk_status, sigmoid
from riskflow.operators.columns import SERVING_SPEC, EncoderSpec, encode_survey, require_columns
from riskflow.operators.scaling import z_score
from riskflow.sources.parameters import Params

# Field names of a score request -> feature names.
REQUEST_FIELDS = {
    "age": "age",
    "cgpa": "cgpa",
    "ap": "academic_pressure",
    "ss": "study_satisfaction",
    "fs": "financial_stress",
    "sd": "sleep_duration",
    "gender": "gender",
    "fh": "family_history",
}


def logit(params: Params, zero_std: str = "zero") -> Column:
    """Intercept plus weighted z-scores, with the parameters as literals."""
    if params.coefficients is None or params.intercept is None:
        raise ValueError(f"parameters of model {params.model} have no coefficients")
    total = F.lit(float(params.intercept))
    for name, mean, std, weight in zip(
        params.names, params.means, params.stds, params.coefficients
    ):
        total = total + z_score(F.col(name), mean, std, zero_std) * F.lit(float(weight))
    return total


def score_params(
    df: DataFrame, params: Params, zero_std: str = "zero", out: str = "probability"
) -> DataFrame:
    """Add the logistic probability of encoded, numeric feature columns."""
    require_columns(df, params.names)
    return df.withColumn(out, sigmoid(logit(params, zero_std)))


def score_details(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Add percent, status and the struct of risk shares to scored rows."""
    return df.withColumns(
        {
            "percent": percent(probability),
            "status": risk_status(probability),
            "risk": risk_components(),
        }
    )


def score_requests(
    df: DataFrame, params: Params, spec: EncoderSpec = SERVING_SPEC, id: str | None = "id"
) -> DataFrame:
    """Answer score requests: ``probability, percent, status, risk, error``.

    Takes request field names or feature names, as text or numbers, from a batch or a
    stream. A request with a number that is missing, NaN or does not parse gets an ``error``
    and no score.
    """
    named = df.toDF(*[REQUEST_FIELDS.get(c, c) for c in df.columns])
    require_columns(named, params.names)
    numbers = [c for c in params.names if c not in spec]
    encoded = encode_survey(named, spec).withColumns(
        {
            c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) for c in numbers
        }
    )
    problems = F.concat_ws(
        "; ", *[F.when(F.col(c).isNull(), F.lit(f"no number in {c}")) for c in numbers]
    )
    scored = score_details(score_params(encoded, params)).withColumn(
        "error", F.nullif(problems, F.lit(""))
    )
    good = F.col("error").isNull()
    kept = [id] if id and id in named.columns else []
    return scored.select(
        *kept,
        *[F.when(good, F.col(c)).alias(c) for c in ("probability", "percent", "status", "risk")],
        "error",
    )
