"""End-to-end flows on files, the request stream, and the driver contract."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from riskflow import contract as C
from riskflow.operators.scoring import score_requests
from riskflow.plans import flows
from riskflow.plans.oracles import ORACLES
from riskflow.plans.queries import QUERIES, RAW_NAMES
from riskflow.plans.survey_view import survey
from riskflow.sources.parameters import current_params, fallback_params, publish_params, read_params, stored_params
from riskflow.streaming.score_stream import read_requests, start_scoring, start_scoring_once


@pytest.fixture(scope="module")
def csv(spark, small_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("csv") / "survey")
    df = survey(spark, small_dir)
    df.toDF(*[RAW_NAMES.get(c, c) for c in df.columns]).write.option("header", True).option(
        "sep", ";"
    ).csv(path)
    return path


def test_train_export_and_reload(spark, csv, tmp_path):
    params_path, model_path = str(tmp_path / "params"), str(tmp_path / "model")
    params = flows.train_and_export(spark, csv, params_path, model_path)
    assert params.features == C.FEATURES and len(params.coefficients) == 8
    assert read_params(spark, params_path) == params
    again = flows.export_saved_model(spark, model_path, str(tmp_path / "again"))
    assert again == params


def test_evaluate_formula(spark, small_dir, tmp_path):
    path = str(tmp_path / "comma")
    df = survey(spark, small_dir)
    df.toDF(*[RAW_NAMES.get(c, c) for c in df.columns]).write.option("header", True).csv(path)
    record = tmp_path / "model_params.json"
    record.write_text(json.dumps(C.STORED_PARAMETERS))
    report, reliability = flows.evaluate_formula(spark, path, str(record), replicates=20)
    rows = {r.metric: r for r in report.collect()}
    assert set(rows) == {"accuracy", "f1", "precision", "recall"}
    row = reliability.collect()[0]
    want = rows["accuracy"]["mean"] * 0.6 + rows["f1"]["mean"] * 0.4 - rows["accuracy"]["std"] * 2
    assert row.score == pytest.approx(want)


def test_noisy_task_uses_every_other_column(spark, small_dir):
    df = survey(spark, small_dir).withColumns(
        {"City": F.lit("x"), "Work Hours": F.col("id").cast("string")}
    )
    noisy = flows.perturbed(df)
    assert "City" not in noisy.columns and "Work Hours" in noisy.columns
    assert noisy.filter(f"{C.LABEL} <> flipped").count() == int(noisy.count() * C.FLIP_RATE)


def test_experiment_and_its_parameters(spark, small_dir):
    done = flows.knn_experiment(survey(spark, small_dir))
    assert done.predictions.count() == survey(spark, small_dir).count()
    assert done.report.count() == 7
    params = flows.knn_params(done)
    assert (params.model, params.knn_k, len(params.means)) == ("KNN", 5, 8)
    assert flows.svm_params(done, 12).n_support_vectors == 12


def test_knn_experiment_is_the_same_in_blocks(spark, small_dir):
    df = survey(spark, small_dir)
    one, other = (
        {tuple(r) for r in flows.knn_experiment(df, mode=m).predictions.collect()}
        for m in ("broadcast", "blocked")
    )
    assert one == other


def test_small_forest_and_kernel_experiments(spark, small_dir):
    df = survey(spark, small_dir)
    forest = flows.forest_experiment(df, k=2, numTrees=5, maxDepth=3)
    svm = flows.svm_experiment(df, k=2, n_features=16, calibration_folds=0)
    for done in (forest, svm):
        assert done.predictions.count() == df.count() and done.report.count() == 4


REQUESTS = [
    {"id": 1, "age": "21", "cgpa": "3.1", "ap": "5", "ss": "1", "fs": "5",
     "sd": "Less than 5 hours", "gender": "Male", "fh": "Yes"},
    {"id": 2, "age": "x", "cgpa": "3.1", "ap": "5", "ss": "1", "fs": "5",
     "sd": "7-8 hours", "gender": "Female", "fh": "No"},
]
REQUEST_SCHEMA = "id bigint, age string, cgpa string, ap string, ss string, fs string, " \
                 "sd string, gender string, fh string"


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def drain():
        stream = read_requests(spark, str(inbox), REQUEST_SCHEMA, max_files=1)
        start_scoring(stream, stored_params(), out, checkpoint, available_now=True).awaitTermination()
        return sorted(map(str, spark.read.parquet(out).select("id", "probability", "error").collect()))

    (inbox / "a.json").write_text(json.dumps(REQUESTS[0]))
    assert len(drain()) == 1
    (inbox / "b.json").write_text(json.dumps(REQUESTS[1]))
    batch = score_requests(
        spark.read.schema(REQUEST_SCHEMA).json(str(inbox)), stored_params()
    ).select("id", "probability", "error")
    assert drain() == sorted(map(str, batch.collect()))


def test_stream_answers_once_and_follows_published_parameters(spark, tmp_path):
    """Repeated, late, too late and nameless requests; new parameters without a restart."""
    inbox, published = tmp_path / "inbox", str(tmp_path / "published")
    inbox.mkdir()
    with pytest.raises(ValueError):
        current_params(spark, published)
    assert publish_params(spark, stored_params(), published) == 1
    stream = read_requests(spark, str(inbox), REQUEST_SCHEMA + ", sent_at timestamp", max_files=1)
    out = str(tmp_path / "out")
    query = start_scoring_once(stream, published, out, str(tmp_path / "checkpoint"), late="10 minutes")

    def send(name, *requests):
        lines = [json.dumps({**REQUESTS[0], "id": i, "sent_at": t}) for i, t in requests]
        (inbox / f".{name}").write_text("\n".join(lines))
        (inbox / f".{name}").rename(inbox / f"{name}.json")
        query.processAllAvailable()
        return sorted(
            ((r.id, r.version) for r in spark.read.parquet(out).select("id", "version").collect()),
            key=str,
        )

    try:
        at = "2026-01-01T10:{}:00Z".format
        assert send("a", (1, at("00")), (1, at("01")), (2, at("05"))) == [(1, 1), (2, 1)]
        assert publish_params(spark, fallback_params(), published) == 2
        # 1 is repeated; 3 is late but within the watermark; 4 and a nameless one are new.
        got = send("b", (1, at("06")), (3, at("01")), (4, at("30")), (None, at("30")), (None, at("30")))
        assert got == [(1, 1), (2, 1), (3, 2), (4, 2), (None, 2)]
        # By now the watermark stands at 10:20, so 5 is too late and 6, without a time, is not.
        assert send("c", (5, at("02")), (6, None)) == [*got[:4], (6, 2), got[4]]
        chance = {r.id: r.probability for r in spark.read.parquet(out).collect()}
        assert chance[1] == chance[2] != chance[3] == chance[4]
    finally:
        query.stop()


def test_driver_contract(spark, small_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())


def test_queries_agree_with_sql(spark, small_dir):
    """Every query that has SQL gives the rows that SQL gives."""
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    con = duckdb.connect()
    for path in sorted(pathlib.Path(small_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    wrong = []
    for name, sql in ORACLES.items():
        ours, theirs = (
            df[sorted(df.columns)].sort_values(sorted(df.columns), ignore_index=True)
            for df in (QUERIES[name](spark, small_dir).toPandas(), con.execute(sql).df())
        )
        try:
            pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, check_exact=True)
        except AssertionError as e:
            wrong.append(f"{name}: {str(e)[:300]}")
    assert not wrong, "\n".join(wrong)


def test_jobs_from_the_command_line(spark, csv, tmp_path):
    from riskflow.__main__ import main

    params, report, out = (str(tmp_path / n) for n in ("params", "report", "out"))
    main(["train", csv, params])
    assert read_params(spark, params).model == "LR"
    main(["experiment", "knn", csv, report, "--artifacts", str(tmp_path / "knn")])
    assert spark.read.json(report).count() == 7
    assert read_params(spark, str(tmp_path / "knn" / "params")).knn_k == 5
    requests = tmp_path / "requests.json"
    requests.write_text("\n".join(map(json.dumps, REQUESTS)))
    main(["score", str(requests), params, out, "--schema", REQUEST_SCHEMA])
    assert spark.read.parquet(out).filter("error is null").count() == 1
