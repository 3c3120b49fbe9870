"""Registered queries: each operator of the library on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import contract as C
from riskflow.functions.coerce import coerce_label, coerce_numeric, parse_label
from riskflow.functions.scalar import decide, percent, risk_components, risk_status, rounded
from riskflow.operators.bootstrap import (
    bootstrap_metrics,
    bootstrap_report,
    bootstrap_weights,
    reliability_score,
)
from riskflow.operators.columns import (
    BILINGUAL_SPEC,
    LENIENT_SPEC,
    SERVING_SPEC,
    TRAINING_SPEC,
    encode_survey,
    numeric_features,
)
from riskflow.operators.evaluate import (
    auc_binned,
    auc_exact,
    binary_metrics,
    confusion,
    roc_curve,
    weighted_metrics,
)
from riskflow.operators.fold_stats import fill_by_fold, fold_states, held_out_stats, standardize_by_fold
from riskflow.operators.folded_logreg import fit_logreg_folds, fold_gradients
from riskflow.operators.folds import ordered_folds, random_folds, stratified_folds
from riskflow.operators.impute import apply_fill, feature_stats, fit_fill
from riskflow.operators.kernel_machine import (
    KernelMachineModel,
    fit_platt,
    margin_bins,
    train_rbf_svm,
)
from riskflow.operators.models import (
    feature_importance,
    score_model,
    train_forest,
    stage_of,
    train_logreg,
)
from riskflow.operators.neighbors import approx_knn_join, knn_classify, knn_join
from riskflow.operators.perturb import class_weights, flip_labels, gaussian_jitter
from riskflow.operators.ranking import exact_quantiles, global_rank, running_sum
from riskflow.operators.scaling import apply_standardize, fit_standardize
from riskflow.operators.scoring import score_params, score_requests
from riskflow.operators.validate import cv_report
from riskflow.plans.flows import (
    balanced_logreg_experiment,
    clean,
    final_forest,
    forest_experiment,
    knn_experiment,
    lenient_scored,
    logreg_experiment,
    svm_experiment,
)
from riskflow.plans.survey_view import as_survey, survey
from riskflow.sources.parameters import (
    Params,
    extract_params,
    fallback_params,
    load_model,
    params_to_df,
    publish_params,
    read_params,
    save_model,
    stored_params,
    write_forest_summary,
    write_params,
)
from riskflow.sources.survey import (
    CORRUPT,
    count_rows,
    read_survey,
    read_survey_lenient,
    split_bad_rows,
)
from riskflow.streaming.score_stream import start_scoring, start_scoring_once
from riskflow.workspace import fresh_path, stage

Query = Callable[[SparkSession, str], DataFrame]

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RAW_NAMES = {v: k for k, v in {**C.RAW_FEATURES, C.RAW_LABEL: C.LABEL}.items()}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in cols})


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(survey(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey scored with the stored parameters; folds come from the id.

    The score is kept to nine decimals so that it groups alike everywhere.
    """
    scored = score_params(_filled(spark, sf_dir), stored_params())
    return scored.select(
        "id",
        (F.col("id") % 5).cast("int").alias("fold"),
        F.col(C.LABEL).alias("label"),
        F.round("probability", 9).alias("score"),
        decide("probability").alias("prediction"),
    )


# --- encoders -------------------------------------------------------------------------


def survey_encoded(spark, sf_dir):
    return encode_survey(survey(spark, sf_dir), TRAINING_SPEC).select(
        "id", *C.TEXT_FEATURES, C.LABEL
    )


def survey_encoded_bilingual(spark, sf_dir):
    translated = survey(spark, sf_dir).withColumns(
        {
            "gender": F.when(F.col("id") % 3 == 0, F.when(F.col("gender") == "Male", "Nam")
                             .when(F.col("gender") == "Female", "Nữ"))
            .otherwise(F.col("gender")),
            "family_history": F.when(
                F.col("id") % 4 == 0,
                F.when(F.col("family_history") == "Yes", "Có").otherwise("Không"),
            ).otherwise(F.col("family_history")),
        }
    )
    return encode_survey(translated, BILINGUAL_SPEC).select("id", *C.TEXT_FEATURES)


def survey_token_encode(spark, sf_dir):
    messy = survey(spark, sf_dir).withColumns(
        {
            "gender": F.when(F.col("id") % 3 == 0, F.upper("gender"))
            .when(F.col("id") % 7 == 0, F.lit("1")).otherwise(F.col("gender")),
            "family_history": F.when(F.col("id") % 5 == 0, F.lit("1"))
            .when(F.col("id") % 6 == 0, F.lit("CÓ")).otherwise(F.col("family_history")),
            "sleep_duration": F.when(F.col("id") % 4 == 0, F.upper("sleep_duration"))
            .when(F.col("id") % 9 == 0, F.lit("Dưới 5 tiếng"))
            .when(F.col("id") % 11 == 0, F.lit("trên 8 tiếng"))
            .otherwise(F.col("sleep_duration")),
        }
    )
    return encode_survey(messy, LENIENT_SPEC).select("id", *C.TEXT_FEATURES)


def survey_serving_encode(spark, sf_dir):
    return encode_survey(survey(spark, sf_dir), SERVING_SPEC).select("id", *C.TEXT_FEATURES)


def risk_components_query(spark, sf_dir):
    df = _filled(spark, sf_dir).withColumn("risk", risk_components())
    return _round(
        df.select("id", "risk.ap", "risk.fs", "risk.sd", "risk.ss"), "ap", "fs", "sd", "ss"
    )


# --- sources and coercion -------------------------------------------------------------


def _raw_file(spark, sf_dir, sep: str, pad: str = " ") -> str:
    """The survey written as a delimited file under its raw headers."""
    path = fresh_path(spark, "survey-csv")
    df = survey(spark, sf_dir)
    named = df.toDF(*[pad + RAW_NAMES.get(c, c) + pad for c in df.columns])
    named.write.option("sep", sep).option("header", True).csv(path)
    return path


def csv_roundtrip_semicolon(spark, sf_dir):
    back = read_survey(spark, _raw_file(spark, sf_dir, ";"))
    return back.select(
        F.col("id").cast("bigint").alias("id"),
        *[F.col(raw).alias(name) for raw, name in C.RAW_FEATURES.items()],
        F.col(C.RAW_LABEL).cast("int").alias(C.LABEL),
    )


def csv_mixed_headers(spark, sf_dir):
    """A folder whose files differ in delimiter, column order and columns."""
    path = fresh_path(spark, "survey-csv")
    df = survey(spark, sf_dir)
    named = df.toDF(*[RAW_NAMES.get(c, c) for c in df.columns])
    part = F.pmod("id", F.lit(3))
    for i, (sep, columns) in enumerate(
        [(",", named.columns), (";", named.columns[::-1]), (",", [c for c in named.columns[2:] if c != "CGPA"] + ["id"])]
    ):
        rows = named.where(part == i).select(*[F.col(f"`{c}`") for c in columns])
        rows.write.mode("append").option("sep", sep).option("header", True).csv(path)
    back = read_survey(spark, path)
    return back.select(
        F.col("id").cast("bigint").alias("id"),
        *[F.col(raw).alias(name) for raw, name in C.RAW_FEATURES.items()],
        F.col(C.RAW_LABEL).cast("int").alias(C.LABEL),
    )


def csv_roundtrip_inferred(spark, sf_dir):
    path = _raw_file(spark, sf_dir, ",")
    back = read_survey(spark, path, seps=(",",), infer=True)
    return back.select(
        F.col("id").cast("bigint").alias("id"), "Age", "CGPA", F.col("Gender"),
        F.col(C.RAW_LABEL).cast("int").alias(C.RAW_LABEL),
    )


def _messy_text(spark, sf_dir) -> DataFrame:
    """The survey as text, with tokens that do not parse."""
    df = survey(spark, sf_dir)
    return df.select(
        "id",
        F.when(F.col("id") % 10 == 0, F.lit("abc")).otherwise(
            F.col("age").cast("int").cast("string")
        ).alias("Age"),
        F.when(F.col("id") % 13 == 0, F.lit("n/a")).otherwise(
            F.col("academic_pressure").cast("int").cast("string")
        ).alias("Academic Pressure"),
        F.when(F.col("id") % 9 == 0, F.lit("True")).when(F.col("id") % 9 == 1, F.lit("yes"))
        .when(F.col("id") % 9 == 2, F.lit("YES")).when(F.col("id") % 9 == 3, F.lit("1.7"))
        .otherwise(F.col(C.LABEL).cast("string")).alias(C.RAW_LABEL),
    )


def lenient_load(spark, sf_dir):
    path = fresh_path(spark, "survey-csv")
    _messy_text(spark, sf_dir).write.option("header", True).csv(path)
    raw = read_survey_lenient(spark, path)
    scored = lenient_scored(raw, fallback_params())
    return scored.select(
        F.col("id").cast("bigint").alias("id"), "age", "cgpa", "academic_pressure", "gender",
        "family_history", "sleep_duration", C.LABEL,
        rounded("probability").alias("probability"), "prediction",
    )


def bad_row_counts(spark, sf_dir):
    path = fresh_path(spark, "survey-csv")
    _messy_text(spark, sf_dir).write.option("header", True).csv(path)
    df = read_survey(spark, path, corrupt=CORRUPT)
    good, bad = split_bad_rows(df)
    kept = good.agg(F.lit("good").alias("kind"), F.sum("Age").alias("age_sum"),
                    F.count("id").alias("rows"))
    lost = bad.agg(F.lit("bad").alias("kind"), F.sum("Age").alias("age_sum"),
                   F.count("id").alias("rows"))
    return kept.unionByName(lost)


def bad_row_total(spark, sf_dir):
    path = fresh_path(spark, "survey-csv")
    _messy_text(spark, sf_dir).write.option("header", True).csv(path)
    return count_rows(read_survey(spark, path, corrupt=CORRUPT))


def label_parse(spark, sf_dir):
    raw = _messy_text(spark, sf_dir)
    return raw.select("id", parse_label(F.col(C.RAW_LABEL), C.TRUTHY_LABELS).alias("label"))


def coerce_label_query(spark, sf_dir):
    raw = _messy_text(spark, sf_dir)
    return raw.select("id", coerce_label(F.col(C.RAW_LABEL), default=0).alias("label"))


def coerce_numeric_query(spark, sf_dir):
    raw = _messy_text(spark, sf_dir)
    age = F.col("Age")
    return raw.select(
        "id",
        coerce_numeric(age).alias("age"),
        coerce_numeric(age, default=20).alias("age_default"),
        coerce_numeric(F.col("id"), strict=True).alias("id_double"),
    )


# --- fills and scaling ----------------------------------------------------------------


def _encoded(spark, sf_dir) -> DataFrame:
    return numeric_features(encode_survey(survey(spark, sf_dir)), C.FEATURES)


def fill_mean(spark, sf_dir):
    df = _encoded(spark, sf_dir)
    return _round(apply_fill(df, fit_fill(df, C.FEATURES)).select("id", *C.FEATURES), *C.FEATURES)


def fill_median(spark, sf_dir):
    df = _encoded(spark, sf_dir)
    fill = fit_fill(df, C.FEATURES, "median", rel_err=0)
    return _round(apply_fill(df, fill).select("id", *C.FEATURES), *C.FEATURES)


def feature_stats_query(spark, sf_dir):
    stats = feature_stats(_encoded(spark, sf_dir), C.FEATURES, ("mean", "std", "std_pop", "count"))
    return _round(stats, "mean", "std", "std_pop")


def exact_medians(spark, sf_dir):
    return exact_quantiles(_table(spark, sf_dir, "lineitem"), LINE_FEATURES, 0.5)


def _standardized(df: DataFrame, key: list[str], cols: list[str], ddof: int) -> DataFrame:
    moments = fit_standardize(df, cols, ddof)
    return _round(apply_standardize(df.select(*key, *cols), moments), *cols)


def standardize_sample(spark, sf_dir):
    return _standardized(_filled(spark, sf_dir), ["id"], C.FEATURES, 1)


def standardize_pop(spark, sf_dir):
    return _standardized(_filled(spark, sf_dir), ["id"], C.FEATURES, 0)


def standardize_lineitem(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem")
    moments = fit_standardize(line, LINE_FEATURES)
    scaled = apply_standardize(line, moments, suffix="_z")
    zs = [f"{c}_z" for c in LINE_FEATURES]
    return _round(scaled.select(*LINE_KEY, *zs), *zs)


def standardize_constant(spark, sf_dir):
    """Both rules for a feature that does not vary."""
    df = survey(spark, sf_dir).select("id", F.lit(4.0).alias("same"))
    moments = fit_standardize(df, ["same"])
    shifted = type(moments)(("same",), (3.0,), moments.stds)
    zero = apply_standardize(df, shifted, "zero", "_zero")
    return apply_standardize(zero, shifted, "one", "_one")


def scaler_export(spark, sf_dir):
    """Means and deviations read back from a fitted, saved and loaded pipeline."""
    df = _filled(spark, sf_dir)
    model = train_logreg(df, C.FEATURES, C.LABEL, max_iter=5)
    path = fresh_path(spark, "model")
    save_model(model, path)
    params = extract_params(load_model(path))
    rows = list(zip(params.names, params.means, params.stds))
    return _round(
        spark.createDataFrame(rows, "feature string, mean double, std double"), "mean", "std"
    )


# --- scoring --------------------------------------------------------------------------


def score_params_query(spark, sf_dir):
    scored = score_params(_filled(spark, sf_dir), stored_params())
    return scored.select("id", rounded("probability").alias("probability"))


def score_fallback(spark, sf_dir):
    """Parameters read from a path with nothing in it fall back to the defaults."""
    params = read_params(spark, fresh_path(spark, "absent"), default=fallback_params())
    scored = score_params(_filled(spark, sf_dir), params, zero_std="one")
    return scored.select("id", rounded("probability").alias("probability"))


def score_details_query(spark, sf_dir):
    """Parameters written and read back, then a full answer per row."""
    path = fresh_path(spark, "params")
    write_params(spark, stored_params(), path)
    scored = score_params(_filled(spark, sf_dir), read_params(spark, path))
    return scored.select(
        "id",
        rounded("probability").alias("probability"),
        percent("probability").alias("percent"),
        risk_status("probability").alias("status"),
        decide("probability").alias("prediction"),
    )


def _requests(df: DataFrame) -> DataFrame:
    """Survey rows as score requests; missing numbers stay missing."""
    return df.select(
        "id", "age", "cgpa", F.col("academic_pressure").alias("ap"),
        F.col("study_satisfaction").alias("ss"), F.col("financial_stress").alias("fs"),
        F.col("sleep_duration").alias("sd"), "gender", F.col("family_history").alias("fh"),
    )


def _answers(df: DataFrame) -> DataFrame:
    return df.select(
        "id", rounded("probability").alias("probability"),
        F.col("percent").cast("double").alias("percent"), "status",
        rounded("risk.ap").alias("ap"), rounded("risk.fs").alias("fs"),
        rounded("risk.sd").alias("sd"), rounded("risk.ss").alias("ss"), "error",
    )


def score_requests_query(spark, sf_dir):
    return _answers(score_requests(_requests(survey(spark, sf_dir)), stored_params()))


def stream_score(spark, sf_dir):
    schema = _table(spark, sf_dir, "customer").schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "customer.parquet")
        .parquet(sf_dir)
    )
    out, checkpoint = fresh_path(spark, "answers"), fresh_path(spark, "answers-checkpoint")
    query = start_scoring(
        _requests(as_survey(stream)), stored_params(), out, checkpoint, available_now=True
    )
    query.awaitTermination()
    return _answers(spark.read.parquet(out))


def stream_score_once(spark, sf_dir):
    """Every request is sent two times, the second a minute later, and answered once."""
    schema = _table(spark, sf_dir, "customer").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    sent = _requests(as_survey(stream)).withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    sent = sent.withColumn("sent_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60)).drop("turn")
    out, params, checkpoint = (fresh_path(spark, n) for n in ("answers", "published", "answers-checkpoint"))
    publish_params(spark, stored_params(), params)
    start_scoring_once(sent, params, out, checkpoint, available_now=True).awaitTermination()
    return _answers(spark.read.parquet(out))


# --- ranks and folds ------------------------------------------------------------------


def global_rank_lineitem(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem").select("l_quantity", *LINE_KEY)
    return global_rank(line, "l_quantity", LINE_KEY)


def global_rank_text(spark, sf_dir):
    """A text key with few values, in the order of a text id."""
    docs = _table(spark, sf_dir, "documents").select(
        "source", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name")
    )
    return global_rank(docs, "source", "name")


def global_rank_bigint(spark, sf_dir):
    """Keys that differ by less than a double can tell."""
    line = _table(spark, sf_dir, "lineitem").select(
        (F.lit(1 << 53) + F.col("l_orderkey")).alias("key"), *LINE_KEY
    )
    return global_rank(line, "key", LINE_KEY)


def running_sum_events(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    cents = F.round(F.col("value") * 100).cast("bigint")
    summed = running_sum(
        events, "value", "event_id", {"cum_cents": cents}, by="event_type", descending=True,
        totals={"total_cents": "cum_cents"},
    )
    return summed.select("event_id", "cum_cents", "total_cents")


def random_folds_query(spark, sf_dir):
    return random_folds(survey(spark, sf_dir)).select("id", "fold")


def ordered_folds_query(spark, sf_dir):
    return ordered_folds(_filled(spark, sf_dir), "age", "id").select("id", "fold")


def ordered_folds_lineitem(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem").select("l_quantity", *LINE_KEY)
    return ordered_folds(line, "l_quantity", LINE_KEY).select(*LINE_KEY, "fold")


def ordered_folds_text_id(spark, sf_dir):
    """Folds of a survey as it is read from a file, where ids are text."""
    back = read_survey(spark, _raw_file(spark, sf_dir, ";"))
    return ordered_folds(back, "Age", "id").select("id", "fold")


def stratified_folds_many(spark, sf_dir):
    """More classes than literals are made for."""
    orders = _table(spark, sf_dir, "orders")
    return stratified_folds(orders, "o_custkey", id="o_orderkey").select(
        "o_orderkey", "o_custkey", "fold"
    )


def stratified_folds_query(spark, sf_dir):
    return stratified_folds(survey(spark, sf_dir), C.LABEL).select("id", C.LABEL, "fold")


def stratified_folds_toxic(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    return stratified_folds(labels, "toxic", id="doc_id").select("doc_id", "toxic", "fold")


# --- perturbation and weights ---------------------------------------------------------


def gaussian_jitter_query(spark, sf_dir):
    noisy = gaussian_jitter(_filled(spark, sf_dir))
    return _round(noisy.select("id", *C.JITTER_COLUMNS), *C.JITTER_COLUMNS)


def flip_labels_query(spark, sf_dir):
    return flip_labels(survey(spark, sf_dir), C.LABEL).select("id", C.LABEL, "flipped")


def class_weights_query(spark, sf_dir):
    return _round(class_weights(survey(spark, sf_dir), C.LABEL).select("id", "weight"), "weight")


def class_weights_toxic(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    return _round(class_weights(labels, "toxic").select("doc_id", "toxic", "weight"), "weight")


def class_weights_many(spark, sf_dir):
    weighted = class_weights(_table(spark, sf_dir, "orders"), "o_custkey")
    return _round(weighted.select("o_orderkey", "weight"), "weight")


# --- nearest neighbours ---------------------------------------------------------------


def _knn_pairs(spark, sf_dir, mode: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    pairs = knn_join(rows, rows, 5, "embedding", "vec_id", exclude="vec_id", mode=mode)
    return _round(pairs, "distance")


def knn_join_query(spark, sf_dir):
    return _knn_pairs(spark, sf_dir, "auto")


def knn_join_blocked(spark, sf_dir):
    return _knn_pairs(spark, sf_dir, "blocked")


def knn_join_approx(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    pairs = approx_knn_join(rows, rows, 5, "embedding", "vec_id", exclude="vec_id")
    return _round(pairs, "distance")


def knn_classify_query(spark, sf_dir):
    """Vectors of even id vote on the label of the vectors of odd id."""
    rows = _table(spark, sf_dir, "embeddings").withColumn(
        "side", (F.col("vec_id") % 2).cast("int")
    )
    voted = knn_classify(rows, rows, 5, "embedding", "label", id="vec_id", exclude="side")
    return _round(voted, "score")


def cv_knn(spark, sf_dir):
    return _report(knn_experiment(survey(spark, sf_dir)).report)


# --- metrics --------------------------------------------------------------------------


def _report(df: DataFrame) -> DataFrame:
    """Rounded report; the sample count, missing in two rows, as a double."""
    counted = df.withColumn("samples", F.col("samples").cast("double"))
    return _round(counted, "accuracy", "precision", "recall", "f1", "auc")


def confusion_query(spark, sf_dir):
    return confusion(_scored(spark, sf_dir), "label", "prediction", "fold")


def binary_metrics_query(spark, sf_dir):
    out = binary_metrics(_scored(spark, sf_dir), "label", "prediction", "fold")
    return _round(out, "accuracy", "precision", "recall", "f1")


def weighted_metrics_query(spark, sf_dir):
    out = weighted_metrics(_scored(spark, sf_dir), "label", "prediction", "fold")
    return _round(out, "accuracy", "precision", "recall", "f1")


def auc_exact_query(spark, sf_dir):
    return _round(auc_exact(_scored(spark, sf_dir), "label", "score", "fold"), "auc")


def auc_overall(spark, sf_dir):
    return _round(auc_exact(_scored(spark, sf_dir), "label", "score"), "auc")


def auc_binned_query(spark, sf_dir):
    return _round(auc_binned(_scored(spark, sf_dir), "label", "score", "fold"), "auc")


def auc_lineitem(spark, sf_dir):
    """Heavy ties: fifty quantities as the score of whether a line was returned."""
    line = _table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_quantity").alias("score"),
        F.col("l_linenumber").alias("line"),
    )
    return _round(auc_exact(line, "label", "score", "line"), "auc")


def roc_curve_query(spark, sf_dir):
    points = roc_curve(_scored(spark, sf_dir), "label", "score", "fold")
    return _round(points, "threshold", "fpr", "tpr")


def fold_report_params(spark, sf_dir):
    return _report(cv_report(_scored(spark, sf_dir), "binary", ddof=1))


def fold_report_weighted(spark, sf_dir):
    return _report(cv_report(_scored(spark, sf_dir), "weighted", ddof=0))


def fold_report_mixed(spark, sf_dir):
    return _report(cv_report(_scored(spark, sf_dir), "mixed", ddof=1))


# --- statistics within folds ------------------------------------------------------------


def _lines_by_fold(spark, sf_dir) -> DataFrame:
    """Lines with gaps in two columns; folds come from the order key."""
    gap = lambda c, k: F.when(F.col("l_partkey") % k != 0, F.col(c).cast("double")).alias(c)
    return _table(spark, sf_dir, "lineitem").select(
        *LINE_KEY[:4], (F.col("l_orderkey") % 5).cast("int").alias("fold"),
        gap("l_quantity", 7), gap("l_extendedprice", 11),
    )


def fold_moments(spark, sf_dir):
    stats = held_out_stats(fold_states(_lines_by_fold(spark, sf_dir), LINE_FEATURES[:2]))
    return _round(stats.drop("quantile"), "mean", "std", "std_pop")


def fold_approx_median(spark, sf_dir):
    """Whether the sketched median of the rows outside each fold has a rank within 1 % of the middle."""
    lines = _lines_by_fold(spark, sf_dir)
    stats = held_out_stats(fold_states(lines, LINE_FEATURES[:2])).select(
        F.col("fold").alias("held"), "feature", "quantile"
    )
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in LINE_FEATURES[:2]
    ]))
    values = lines.select("fold", cells.alias("r")).select("fold", "r.*").where("x is not null")
    ranked = values.join(F.broadcast(stats), "feature").where("fold <> held").groupBy(
        F.col("held").alias("fold"), "feature"
    ).agg(
        F.count("*").alias("rows"),
        (F.avg((F.col("x") < F.col("quantile")).cast("int")) <= 0.51).alias("low"),
        (F.avg((F.col("x") <= F.col("quantile")).cast("int")) >= 0.49).alias("high"),
    )
    return ranked.select("fold", "feature", "rows", (F.col("low") & F.col("high")).alias("within"))


def fill_mean_by_fold(spark, sf_dir):
    filled = fill_by_fold(_lines_by_fold(spark, sf_dir), LINE_FEATURES[:2])
    return _round(filled, *LINE_FEATURES[:2])


def standardize_by_fold_query(spark, sf_dir):
    scaled = standardize_by_fold(_lines_by_fold(spark, sf_dir), LINE_FEATURES[:2])
    return _round(scaled, *LINE_FEATURES[:2])


# --- bootstrap ------------------------------------------------------------------------


def bootstrap_weights_query(spark, sf_dir):
    drawn = bootstrap_weights(_scored(spark, sf_dir).select("id"))
    return drawn.groupBy("replicate").agg(
        F.count("*").alias("rows"), F.sum("weight").cast("bigint").alias("draws"),
        F.max("weight").alias("most"),
    )


def _replicates(spark, sf_dir) -> DataFrame:
    return bootstrap_metrics(_scored(spark, sf_dir), "label", "prediction", mode="poisson")


def bootstrap_metrics_query(spark, sf_dir):
    return _round(_replicates(spark, sf_dir), "accuracy", "f1", "precision", "recall")


def bootstrap_report_query(spark, sf_dir):
    return _round(bootstrap_report(_replicates(spark, sf_dir)), "mean", "std")


def reliability_score_query(spark, sf_dir):
    return _round(reliability_score(bootstrap_report(_replicates(spark, sf_dir))), "score")


def bootstrap_multinomial(spark, sf_dir):
    return bootstrap_report(bootstrap_metrics(_scored(spark, sf_dir), "label", "prediction"))


# --- trained models -------------------------------------------------------------------


def _gradients(experiment, label: str, C_value: float | None = None, balanced: bool = False) -> DataFrame:
    """Mean gradient of each fold's model; zero where it is optimal."""
    models = fit_logreg_folds(experiment.data, experiment.features, label, C=C_value, balanced=balanced)
    rows = fold_gradients(experiment.data, models, label, C=C_value)
    return rows.withColumn("gradient", F.round("gradient", 7) + F.lit(0.0))


def logreg_gradients(spark, sf_dir):
    return _gradients(logreg_experiment(survey(spark, sf_dir)), C.LABEL)


def logreg_balanced_gradients(spark, sf_dir):
    return _gradients(balanced_logreg_experiment(survey(spark, sf_dir)), "flipped", 1.0, True)


def cv_logreg(spark, sf_dir):
    return logreg_experiment(survey(spark, sf_dir)).report


def cv_logreg_balanced(spark, sf_dir):
    return balanced_logreg_experiment(survey(spark, sf_dir)).report


def cv_forest(spark, sf_dir):
    return forest_experiment(survey(spark, sf_dir)).report


def cv_rbf_svm(spark, sf_dir):
    return svm_experiment(survey(spark, sf_dir)).report


def margin_support(spark, sf_dir):
    """Support vectors of each class of the kernel machine trained on all rows."""
    df = _filled(spark, sf_dir)
    scaled = apply_standardize(df, fit_standardize(df, C.FEATURES))
    model = train_rbf_svm(scaled, C.FEATURES, C.LABEL, standardize=False)
    counts = enumerate(stage_of(model, KernelMachineModel).support_counts())
    support = spark.createDataFrame(list(counts), f"{C.LABEL} int, support long")
    rows = df.groupBy(F.col(C.LABEL).cast("int").alias(C.LABEL)).agg(F.count("*").alias("rows"))
    return rows.join(support, C.LABEL).select(C.LABEL, "rows", "support")


def platt_fit(spark, sf_dir):
    """The calibrating sigmoid over binned margins of the stored model."""
    scored = score_params(_filled(spark, sf_dir), stored_params())
    margin = F.round(F.log(F.col("probability") / (1 - F.col("probability"))), 9)
    rows = stage(scored.select(margin.alias("margin"), C.LABEL), "platt")
    slope, intercept = fit_platt(rows, "margin", C.LABEL)
    total = margin_bins(rows, "margin", C.LABEL).agg(
        F.count("*").alias("bins"), F.sum("negatives").alias("negatives"), F.sum("positives").alias("positives")
    )
    return _round(total.select("*", F.lit(slope).alias("slope"), F.lit(intercept).alias("intercept")), "slope", "intercept")


def neighbor_params(spark, sf_dir):
    """The neighbour form of the parameter record, written and read back."""
    df = _filled(spark, sf_dir)
    moments = fit_standardize(df, C.FEATURES)
    params = Params(list(moments.means), list(moments.stds), features=C.FEATURES, model="KNN",
                    knn_k=5, metric="euclidean")
    path = fresh_path(spark, "params")
    write_params(spark, params, path)
    row = params_to_df(spark, read_params(spark, path))
    pairs = F.explode(F.arrays_zip("features", "means", "stds")).alias("p")
    return _round(
        row.select("model", "knn_k", "metric", pairs).select(
            "model", "knn_k", "metric", F.col("p.features").alias("feature"),
            F.col("p.means").alias("mean"), F.col("p.stds").alias("std"),
        ),
        "mean", "std",
    )


def forest_summary_query(spark, sf_dir):
    """Importances of the forest as the written summary holds them."""
    df = clean(survey(spark, sf_dir), "median")
    model = train_forest(df, C.FEATURES, C.LABEL)
    path = fresh_path(spark, "summary")
    write_forest_summary(spark, model, path, avg_accuracy=0.0)
    back = spark.read.json(path)
    pairs = F.explode(F.arrays_zip("features", "importances")).alias("p")
    return back.select("model_type", pairs).select("model_type", "p.features", "p.importances")


def feature_importance_query(spark, sf_dir):
    data = clean(survey(spark, sf_dir), "median")
    experiment = type("_", (), {"data": data, "features": C.FEATURES})
    return feature_importance(final_forest(experiment), spark)


def params_export(spark, sf_dir):
    """Parameters of a model trained on all rows, and its formula scores beside its own."""
    df = _filled(spark, sf_dir)
    model = train_logreg(df, C.FEATURES, C.LABEL)
    path = fresh_path(spark, "params")
    write_params(spark, extract_params(model), path)
    scored = score_params(score_model(model, df), read_params(spark, path), out="formula")
    return scored.select("id", "score", "formula")


QUERIES: dict[str, Query] = {
    "survey_encoded": survey_encoded,
    "survey_encoded_bilingual": survey_encoded_bilingual,
    "survey_token_encode": survey_token_encode,
    "survey_serving_encode": survey_serving_encode,
    "risk_components": risk_components_query,
    "csv_roundtrip_semicolon": csv_roundtrip_semicolon,
    "csv_mixed_headers": csv_mixed_headers,
    "csv_roundtrip_inferred": csv_roundtrip_inferred,
    "lenient_load": lenient_load,
    "bad_row_counts": bad_row_counts,
    "bad_row_total": bad_row_total,
    "label_parse": label_parse,
    "coerce_label": coerce_label_query,
    "coerce_numeric": coerce_numeric_query,
    "fill_mean": fill_mean,
    "fill_median": fill_median,
    "feature_stats": feature_stats_query,
    "exact_medians": exact_medians,
    "standardize_sample": standardize_sample,
    "standardize_pop": standardize_pop,
    "standardize_lineitem": standardize_lineitem,
    "standardize_constant": standardize_constant,
    "scaler_export": scaler_export,
    "score_params": score_params_query,
    "score_fallback": score_fallback,
    "score_details": score_details_query,
    "score_requests": score_requests_query,
    "stream_score": stream_score,
    "stream_score_once": stream_score_once,
    "global_rank_lineitem": global_rank_lineitem,
    "global_rank_text": global_rank_text,
    "global_rank_bigint": global_rank_bigint,
    "running_sum_events": running_sum_events,
    "random_folds": random_folds_query,
    "ordered_folds": ordered_folds_query,
    "ordered_folds_lineitem": ordered_folds_lineitem,
    "ordered_folds_text_id": ordered_folds_text_id,
    "stratified_folds": stratified_folds_query,
    "stratified_folds_many": stratified_folds_many,
    "stratified_folds_toxic": stratified_folds_toxic,
    "gaussian_jitter": gaussian_jitter_query,
    "flip_labels": flip_labels_query,
    "class_weights": class_weights_query,
    "class_weights_toxic": class_weights_toxic,
    "class_weights_many": class_weights_many,
    "knn_join": knn_join_query,
    "knn_join_blocked": knn_join_blocked,
    "knn_join_approx": knn_join_approx,
    "knn_classify": knn_classify_query,
    "cv_knn": cv_knn,
    "confusion": confusion_query,
    "binary_metrics": binary_metrics_query,
    "weighted_metrics": weighted_metrics_query,
    "auc_exact": auc_exact_query,
    "auc_overall": auc_overall,
    "auc_binned": auc_binned_query,
    "auc_lineitem": auc_lineitem,
    "roc_curve": roc_curve_query,
    "fold_report_params": fold_report_params,
    "fold_report_weighted": fold_report_weighted,
    "fold_report_mixed": fold_report_mixed,
    "fold_moments": fold_moments,
    "fold_approx_median": fold_approx_median,
    "fill_mean_by_fold": fill_mean_by_fold,
    "standardize_by_fold": standardize_by_fold_query,
    "bootstrap_weights": bootstrap_weights_query,
    "bootstrap_metrics": bootstrap_metrics_query,
    "bootstrap_report": bootstrap_report_query,
    "reliability_score": reliability_score_query,
    "bootstrap_multinomial": bootstrap_multinomial,
    "logreg_gradients": logreg_gradients,
    "logreg_balanced_gradients": logreg_balanced_gradients,
    "cv_logreg": cv_logreg,
    "cv_logreg_balanced": cv_logreg_balanced,
    "cv_forest": cv_forest,
    "cv_rbf_svm": cv_rbf_svm,
    "feature_importance": feature_importance_query,
    "forest_summary": forest_summary_query,
    "margin_support": margin_support,
    "platt_fit": platt_fit,
    "neighbor_params": neighbor_params,
    "params_export": params_export,
}
