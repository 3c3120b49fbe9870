"""Files with awkward headers, delimiters and rows."""

import pytest
from pyspark.sql import functions as F

from riskflow.sources.survey import (
    CORRUPT,
    MissingInput,
    count_rows,
    read_survey,
    read_survey_lenient,
    split_bad_rows,
)
from riskflow.workspace import fresh_path, stage, workspace_dir


def _write(tmp_path, text, name="survey.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_delimiter_and_header_spaces(spark, tmp_path):
    path = _write(tmp_path, " id ; Age;Gender \n1;20;Male\n2;x;\n")
    df = read_survey(spark, path)
    assert df.columns == ["id", "Age", "Gender"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", 20.0, "Male"), ("2", None, None)]
    comma = read_survey(spark, _write(tmp_path, "id,Age\n1,20\n", "b.csv"))
    assert comma.columns == ["id", "Age"]


def test_single_delimiter_and_inference(spark, tmp_path):
    path = _write(tmp_path, "id;Age;Depression\n1;20;1\n2;21;0\n")
    assert read_survey(spark, path, seps=(",",)).columns == ["id;Age;Depression"]
    df = read_survey(spark, path, infer=True)
    assert dict(df.dtypes) == {"id": "int", "Age": "int", "Depression": "int"}


def test_missing_file(spark, tmp_path):
    with pytest.raises(MissingInput):
        read_survey(spark, str(tmp_path / "no.csv"))


def test_lenient_defaults_and_byte_order_mark(spark, tmp_path):
    path = _write(tmp_path, "﻿Age,Gender\nabc,Nam\n")
    row = read_survey_lenient(spark, path).collect()[0].asDict()
    assert row["Age"] == "abc" and row["Gender"] == "Nam"
    assert row["CGPA"] == "3.0" and row["Sleep Duration"] == "7-8 hours"
    assert row["Depression"] == "0"


def test_bad_rows_are_judged_by_all_columns(spark, tmp_path):
    path = _write(tmp_path, "id,Age,CGPA,City\n1,20,3,A\n2,x,3,B\n3,20,y,C\n4,,3,D\n")
    df = read_survey(spark, path, corrupt=CORRUPT)
    good, bad = split_bad_rows(df)
    assert {r.id for r in good.select("id").collect()} == {"1", "4"}
    assert {r.id for r in bad.select("id").collect()} == {"2", "3"}
    assert good.columns == ["id", "Age", "CGPA", "City"]
    assert {(r.is_bad, r.rows) for r in count_rows(df).collect()} == {(True, 2), (False, 2)}
    assert bad.filter("id = '3'").collect()[0][CORRUPT] == "3,20,y,C"


def test_workspace_follows_the_session(spark):
    assert workspace_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
    df = stage(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    assert df.agg(F.sum("x")).collect()[0][0] == 90


def _folder(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    """Columns in another order, other delimiters, missing columns and a byte-order mark."""
    path = _folder(
        tmp_path, a="id,Age,CGPA,Gender\n1,20,3.5,Male\n2,21,3.0,Female\n", b="﻿CGPA; id ;Age\n2.5;3;22\n",
        c="Gender,City,id\nMale,Hue,4\n", d="", e="id,Age,CGPA,Gender\n5,x,1.5,\n",
    )
    df = read_survey(spark, path)
    assert df.columns == ["id", "Age", "CGPA", "Gender", "City"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        ("1", 20.0, 3.5, "Male", None), ("2", 21.0, 3.0, "Female", None), ("3", 22.0, 2.5, None, None),
        ("4", None, None, "Male", "Hue"), ("5", None, 1.5, None, None),
    ]
    bad = read_survey(spark, path, corrupt=CORRUPT).where(F.col(CORRUPT).isNotNull()).collect()
    assert [(r["id"], r[CORRUPT]) for r in bad] == [("5", "5,x,1.5,")]
    schema = "Age int, id long, Height double"
    from pyspark.sql.types import StructType

    chosen = read_survey(spark, path, schema=StructType.fromDDL(schema))
    assert sorted(map(tuple, chosen.collect()), key=lambda r: r[1]) == [
        (20, 1, None), (21, 2, None), (22, 3, None), (None, 4, None), (None, 5, None)
    ]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    inferred = read_survey(spark, path, infer=True)
    assert dict(inferred.dtypes)["id"] == "int" and dict(inferred.dtypes)["Age"] == "string"
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_odd_file_names(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    (folder / "x 1.csv").write_text("id,Age\n1,2\n")
    (folder / "y%20[z].csv").write_text("Age,id\n3,4\n")
    got = read_survey(spark, str(folder)).select("id", "Age").collect()
    assert sorted(map(tuple, got)) == [("1", 2.0), ("4", 3.0)]


def test_lenient_files_are_read_by_name(spark, tmp_path):
    path = _folder(tmp_path, a="Age,CGPA\n20,3.5\n", b="CGPA,Age,Gender\n2.5,30,Female\n")
    got = read_survey_lenient(spark, path).orderBy("Age").collect()
    assert [(r["Age"], r["CGPA"], r["Gender"]) for r in got] == [("20", "3.5", "Male"), ("30", "2.5", "Female")]


def test_many_files_of_one_header_are_one_scan(spark, tmp_path):
    from riskflow.sources.survey import layouts

    path = _folder(tmp_path, **{f"f{i}": f"id,Age\n{i},{i}\n" + "9,9\n" * 3000 for i in range(20)})
    assert [x.paths for x in layouts(spark, path, (",", ";"))] == [path]
    assert read_survey(spark, path).count() == 20 * 3001
