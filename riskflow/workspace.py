"""Where intermediate tables live, and small helpers for bounded driver data."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession

In = TypeVar("In")
Out = TypeVar("Out")


def workspace_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Without that setting it is a folder below the session's warehouse, which all
    executors share as well. Nothing is kept in a machine's own temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_workspace"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the workspace that no earlier call has returned."""
    return f"{workspace_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as a columnar table in the workspace and return a scan of it.

    This cuts the lineage, survives the loss of any executor, and lets each later
    reader prune the columns it does not use.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collect_bounded(df: DataFrame, limit: int) -> list[Row] | None:
    """The rows of a frame that must be small, or None when it has more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def side_by_side(
    spark: SparkSession, fn: Callable[[In], Out], items: Iterable[In], width: int
) -> list[Out]:
    """Run independent Spark work from several driver threads; only the results come back."""
    items = list(items)
    with ThreadPool(max(1, min(width, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), items)
