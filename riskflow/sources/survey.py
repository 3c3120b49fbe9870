"""Survey files: delimited text with an unknown delimiter, stray header spaces, bad rows."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.contract import ABSENT_COLUMN_DEFAULTS, RAW_FEATURES, TEXT_FEATURES
from riskflow.operators.columns import normalize_headers, quoted

CORRUPT = "_corrupt_record"


class MissingInput(FileNotFoundError):
    """The survey path does not exist."""


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names; Spark reads only the first line for this."""
    try:
        return spark.read.csv(path, sep=sep, header=True).columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            raise MissingInput(path) from e
        raise


def _sniff(spark: SparkSession, path: str, seps: Sequence[str]) -> tuple[str, list[str]]:
    """The first delimiter that gives more than one column, else the last one."""
    for sep in seps:
        columns = _header(spark, path, sep)
        if len(columns) > 1:
            break
    return sep, columns


@dataclass(frozen=True)
class Layout:
    """Files that share a header line: its delimiter and column names."""

    paths: str | tuple[str, ...]
    sep: str
    columns: tuple[str, ...]

    def read(self, reader) -> DataFrame:
        paths = self.paths if isinstance(self.paths, str) else list(self.paths)
        return reader.option("header", True).option("sep", self.sep).csv(paths)


#: Different header lines that one survey may have.
MOST_LAYOUTS = 1_000


@contextmanager
def _one_task_a_file(spark: SparkSession) -> Iterator[None]:
    """Within this, each file is one split and no two files share a task."""
    settings = {
        "spark.sql.files.maxPartitionBytes": str(1 << 50),
        "spark.sql.files.openCostInBytes": str(1 << 50),
        "spark.sql.files.minPartitionNum": "1",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of a task's file; the others are not asked for."""
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def layouts(spark: SparkSession, path: str, seps: Sequence[str]) -> list[Layout]:
    """The files at ``path`` by their header lines, first file first.

    A task a file fetches its first line. One header line for all files gives one layout
    of the whole path; otherwise each layout lists its files. Empty files have none.
    """
    _header(spark, path, seps[0])  # a missing path is an error of its own
    with _one_task_a_file(spark):
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
        heads = lines.mapInArrow(_first_lines, lines.schema).groupBy("value").agg(
            F.array_sort(F.collect_list("path")).alias("paths")
        )
        # Files are listed as Spark itself lists them to read them.
        found = heads.limit(MOST_LAYOUTS + 1).collect()
    if len(found) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} different header lines")
    if len(found) < 2:
        return [Layout(path, *_as_pair(_sniff(spark, path, seps)))]
    # Spark gives file names as parts of a URI, and takes them as patterns.
    plain = lambda p: re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(p))
    groups = sorted([plain(p) for p in r["paths"]] for r in found)
    return [Layout(tuple(g), *_as_pair(_sniff(spark, g[0], seps))) for g in groups]


def _as_pair(found: tuple[str, list[str]]) -> tuple[str, tuple[str, ...]]:
    return found[0], tuple(found[1])


def _by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of files with different headers: columns by name, null where a file lacks one.

    Columns stand in the order in which they are first met. One that files infer as
    different types is a double if all are numbers, else text.
    """
    types: dict[str, set] = {}
    for part in parts:
        for f in part.schema:
            types.setdefault(f.name, set()).add(f.dataType)
    wide = {
        c: T.DoubleType() if all(isinstance(t, T.NumericType) for t in kinds) else T.StringType()
        for c, kinds in types.items() if len(kinds) > 1
    }
    even = [
        p.withColumns({c: quoted(c).cast(t) for c, t in wide.items() if c in p.columns}) for p in parts
    ]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), even)


def survey_schema(columns: Sequence[str]) -> T.StructType:
    """Types by name: the numeric answers are doubles, everything else is text."""
    fields = []
    for name in columns:
        short = RAW_FEATURES.get(name.strip())
        numeric = short is not None and short not in TEXT_FEATURES
        fields.append(T.StructField(name, T.DoubleType() if numeric else T.StringType()))
    return T.StructType(fields)


def read_survey(
    spark: SparkSession,
    path: str,
    seps: Sequence[str] = (",", ";"),
    schema: T.StructType | None = None,
    infer: bool = False,
    corrupt: str | None = None,
) -> DataFrame:
    """Delimited files with a header; the first of ``seps`` that splits the header is used.

    Files may differ in their delimiter and in which columns they have and where: columns
    are matched by their trimmed names, and are null where a file lacks them.

    Types come from ``schema``, or from the column names, which costs no pass over the
    data; ``infer=True`` lets Spark look at all values first. A numeric answer that does
    not parse becomes null; ``corrupt`` names a column that keeps the text of such rows.
    """
    found = layouts(spark, path, seps)
    if len(found) == 1:
        return _read_layout(spark, found[0], schema, infer, corrupt)
    if schema is None:
        return _by_name([_read_layout(spark, x, None, infer, corrupt) for x in found])
    # A schema is a choice of columns by name here; files may hold others besides.
    kinds = {f.name.strip(): f for f in schema}
    own = lambda x: T.StructType(
        [T.StructField(c, kinds[c.strip()].dataType) if c.strip() in kinds else _text(c) for c in x.columns]
    )
    out = _by_name([_read_layout(spark, x, own(x), infer, corrupt) for x in found])
    absent = {c: F.lit(None).cast(f.dataType) for c, f in kinds.items() if c not in out.columns}
    kept = [*kinds, corrupt] if corrupt else list(kinds)
    return out.withColumns(absent).select(*[quoted(c) for c in kept])


def _read_layout(
    spark: SparkSession, layout: Layout, schema: T.StructType | None, infer: bool, corrupt: str | None
) -> DataFrame:
    reader = spark.read
    if infer:
        return normalize_headers(layout.read(reader.option("inferSchema", True)))
    schema = schema or survey_schema(layout.columns)
    if not corrupt:
        return normalize_headers(layout.read(reader.schema(schema)))
    text = reader.option("columnNameOfCorruptRecord", corrupt).schema(
        T.StructType([*[_text(f.name) for f in schema], _text(corrupt)])
    )
    return normalize_headers(_typed(layout.read(text), schema, layout.sep, corrupt))


def _text(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def _typed(text: DataFrame, schema: T.StructType, sep: str, corrupt: str) -> DataFrame:
    """Cast text columns; keep the text of rows where a cast fails.

    The check names every typed column, so a row is judged alike whichever columns a query
    uses. (The reader itself only notices what it has to convert.)
    """
    typed = {f.name: quoted(f.name).try_cast(f.dataType) for f in schema if not _is_text(f)}
    failed = F.lit(False)
    for name, value in typed.items():
        failed = failed | (quoted(name).isNotNull() & value.isNull())
    whole = F.concat_ws(sep, *[F.coalesce(quoted(f.name), F.lit("")) for f in schema])
    return text.select(
        *[typed.get(f.name, quoted(f.name)).alias(f.name) for f in schema],
        F.coalesce(quoted(corrupt), F.when(failed, whole)).alias(corrupt),
    )


def _is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def read_survey_lenient(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    defaults: Mapping[str, str] = ABSENT_COLUMN_DEFAULTS,
) -> DataFrame:
    """All columns as text; a known column absent from a file gets its default there.

    Files may have their columns in different places: they are matched by name.
    """
    parts = []
    for layout in layouts(spark, path, (sep,)):
        schema = T.StructType([_text(c) for c in layout.columns])
        parts.append(with_absent_columns(layout.read(spark.read.schema(schema)), defaults))
    return _by_name(parts)


def with_absent_columns(
    df: DataFrame, defaults: Mapping[str, str] = ABSENT_COLUMN_DEFAULTS
) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def split_bad_rows(df: DataFrame, corrupt_col: str = CORRUPT) -> tuple[DataFrame, DataFrame]:
    """Rows that parsed and rows that did not."""
    bad = quoted(corrupt_col).isNotNull()
    return df.filter(~bad).drop(corrupt_col), df.filter(bad)


def count_rows(df: DataFrame, corrupt_col: str = CORRUPT) -> DataFrame:
    """``(is_bad, rows)`` in one pass."""
    return df.groupBy(quoted(corrupt_col).isNotNull().alias("is_bad")).agg(
        F.count("*").alias("rows")
    )
