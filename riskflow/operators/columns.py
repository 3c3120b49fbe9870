"""Column-level operators driven by the schema of the frame."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow import contract as C
from riskflow.functions.coerce import coerce_label, coerce_numeric
from riskflow.functions.encode import (
    encode_binary,
    encode_contains,
    encode_map,
    encode_ordinal,
    encode_tokens,
)

# An encoder gets the column and whether its type is numeric.
Encoder = Callable[[Column, bool], Column]
EncoderSpec = Mapping[str, Encoder]

_LEVELS = list(C.SLEEP_LEVELS)

# Encoding used for training: unknown sleep answers count as the longest.
TRAINING_SPEC: EncoderSpec = {
    "gender": lambda c, _: encode_binary(c, "Male"),
    "family_history": lambda c, _: encode_binary(c, "Yes"),
    "sleep_duration": lambda c, _: encode_ordinal(c, _LEVELS[:3], default=3),
}
# Encoding of the bilingual survey: unknown answers become 0, 0 and 1.
BILINGUAL_SPEC: EncoderSpec = {
    "gender": lambda c, _: encode_map(c, C.GENDER_CODES, 0),
    "family_history": lambda c, _: encode_map(c, C.FAMILY_CODES, 0),
    "sleep_duration": lambda c, _: encode_map(c, C.SLEEP_LEVELS, 1),
}
# Tolerant encoding of the score evaluation: case-folded, fragments allowed.
LENIENT_SPEC: EncoderSpec = {
    "gender": lambda c, num: encode_tokens(c, C.GENDER_TOKENS, num),
    "family_history": lambda c, num: encode_tokens(c, C.FAMILY_TOKENS, num),
    "sleep_duration": lambda c, num: encode_contains(c, C.SLEEP_FRAGMENTS, 1.0, num),
}
# Encoding of score requests: exact words, unknown sleep answers become 1.
SERVING_SPEC: EncoderSpec = {
    "gender": lambda c, _: encode_binary(c, "Male").cast("double"),
    "family_history": lambda c, _: encode_binary(c, "Yes").cast("double"),
    "sleep_duration": lambda c, _: encode_map(
        c, {k: float(v) for k, v in C.SLEEP_LEVELS.items()}, 1.0
    ),
}


def quoted(name: str) -> Column:
    """Column reference that is safe for names with dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalize_headers(df: DataFrame) -> DataFrame:
    """Trim every column name, in one projection."""
    return df.toDF(*[c.strip() for c in df.columns])


def short_names(df: DataFrame) -> DataFrame:
    """Rename the known survey headers to the short names of the data model."""
    known = {**C.RAW_FEATURES, C.RAW_LABEL: C.LABEL}
    return df.toDF(*[known.get(c, c) for c in df.columns])


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Raise before any work when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def drop_columns(df: DataFrame, names: Sequence[str] = tuple(C.IGNORED_COLUMNS)) -> DataFrame:
    """Drop the listed columns where present."""
    return df.drop(*names)


def resolve_features(df: DataFrame, features: Sequence[str] = tuple(C.FEATURES)) -> list[str]:
    """The features that exist in the frame, in the given order."""
    return [f for f in features if f in df.columns]


def encode_survey(df: DataFrame, spec: EncoderSpec = TRAINING_SPEC) -> DataFrame:
    """Apply each encoder to its column where the column exists."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {
            name: encoder(quoted(name), isinstance(types[name], T.NumericType))
            for name, encoder in spec.items()
            if name in types
        }
    )


def numeric_features(
    df: DataFrame,
    features: Sequence[str],
    strict: bool = False,
    defaults: Mapping[str, float] | None = None,
) -> DataFrame:
    """Cast the features to double; see ``coerce_numeric``."""
    defaults = defaults or {}
    return df.withColumns(
        {f: coerce_numeric(quoted(f), strict, defaults.get(f)) for f in features}
    )


def prepare_survey(
    df: DataFrame,
    spec: EncoderSpec = TRAINING_SPEC,
    features: Sequence[str] = tuple(C.FEATURES),
    label: str = C.LABEL,
    label_default: int | None = None,
) -> DataFrame:
    """Encode, cast the features that exist to double and the label to int."""
    require_columns(df, [label])
    encoded = encode_survey(df, spec)
    present = resolve_features(encoded, features)
    out = numeric_features(encoded, present)
    return out.withColumn(label, coerce_label(quoted(label), label_default))
