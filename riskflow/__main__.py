"""Jobs for ``spark-submit``: train, export, evaluate, experiment and score.

    spark-submit --py-files riskflow.zip riskflow/__main__.py train SURVEY.csv PARAMS
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from riskflow.operators.columns import short_names
from riskflow.operators.scoring import score_requests
from riskflow.plans import flows
from riskflow.sources.parameters import (
    read_params,
    save_model,
    write_forest_summary,
    write_params,
)
from riskflow.sources.survey import read_survey
from riskflow.streaming.score_stream import start_scoring

EXPERIMENTS = {
    "logreg": flows.logreg_experiment,
    "balanced": flows.balanced_logreg_experiment,
    "forest": flows.forest_experiment,
    "knn": flows.knn_experiment,
    "svm": flows.svm_experiment,
}


def experiment(
    spark: SparkSession, kind: str, csv: str, report: str, artifacts: str | None
) -> DataFrame:
    """Run one experiment; write its report and, if asked, its final model or parameters."""
    raw = short_names(read_survey(spark, csv))
    done = EXPERIMENTS[kind](raw)
    done.report.write.mode("overwrite").json(report)
    if artifacts and kind == "logreg":
        save_model(flows.final_logreg(done), f"{artifacts}/model")
    elif artifacts and kind == "forest":
        model = flows.final_forest(done)
        save_model(model, f"{artifacts}/model")
        average = done.report.filter("fold = 'AVG'").collect()[0]["accuracy"]
        write_forest_summary(spark, model, f"{artifacts}/summary", average, done.features)
    elif artifacts and kind == "knn":
        write_params(spark, flows.knn_params(done), f"{artifacts}/params")
    elif artifacts and kind == "svm":
        support = flows.last_fold_support(done)
        write_params(spark, flows.svm_params(done, support), f"{artifacts}/params")
    return done.report


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="riskflow", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    train = jobs.add_parser("train", help="fit the logistic model and write its parameters")
    train.add_argument("csv")
    train.add_argument("params")
    train.add_argument("--model", help="also save the fitted pipeline here")
    export = jobs.add_parser("export", help="write the parameters of a saved pipeline")
    export.add_argument("model")
    export.add_argument("params")
    evaluate = jobs.add_parser("evaluate", help="bootstrap the quality of stored parameters")
    evaluate.add_argument("csv")
    evaluate.add_argument("params")
    trial = jobs.add_parser("experiment", help="cross-validate one kind of model")
    trial.add_argument("kind", choices=sorted(EXPERIMENTS))
    trial.add_argument("csv")
    trial.add_argument("report")
    trial.add_argument("--artifacts", help="folder for the final model or parameters")
    score = jobs.add_parser("score", help="answer the score requests in a folder of JSON files")
    score.add_argument("requests")
    score.add_argument("params")
    score.add_argument("out")
    score.add_argument("--schema", required=True, help="column names and types of a request")
    score.add_argument("--checkpoint", help="read the folder as a stream, resuming from here")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName(f"riskflow-{args.job}").getOrCreate()
    if args.job == "train":
        flows.train_and_export(spark, args.csv, args.params, args.model)
    elif args.job == "export":
        flows.export_saved_model(spark, args.model, args.params)
    elif args.job == "evaluate":
        report, reliability = flows.evaluate_formula(spark, args.csv, args.params)
        report.show()
        reliability.show(truncate=False)
    elif args.job == "experiment":
        experiment(spark, args.kind, args.csv, args.report, args.artifacts).show()
    elif args.checkpoint:
        stream = spark.readStream.schema(args.schema).json(args.requests)
        start_scoring(
            stream, read_params(spark, args.params), args.out, args.checkpoint
        ).awaitTermination()
    else:
        batch = spark.read.schema(args.schema).json(args.requests)
        answers = score_requests(batch, read_params(spark, args.params))
        answers.write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
