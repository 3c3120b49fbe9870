"""Scoring of request streams.

A score needs no state, so ``start_scoring`` passes rows straight through. ``start_scoring_once``
keeps state to answer a repeated request once, and takes the parameters in force at each batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskflow.operators.columns import SERVING_SPEC, EncoderSpec
from riskflow.operators.scoring import score_requests
from riskflow.sources.parameters import Params, current_params


def read_requests(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "json",
    max_files: int | None = None,
) -> DataFrame:
    """Stream of request files arriving in a folder."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(path)


def start_scoring(
    requests: DataFrame,
    params: Params,
    out: str,
    checkpoint: str,
    spec: EncoderSpec = SERVING_SPEC,
    id: str | None = "id",
    fmt: str = "parquet",
    available_now: bool = False,
) -> StreamingQuery:
    """Append the answer to each request to a file sink; restart continues from ``checkpoint``.

    ``available_now`` processes what is there and stops.
    """
    writer = (
        score_requests(requests, params, spec, id)
        .writeStream.outputMode("append")
        .format(fmt)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def once(requests: DataFrame, id: str = "id", time: str = "sent_at", late: str = "1 hour") -> DataFrame:
    """Requests without those whose id came before, within ``late`` of event time.

    Requests later than the watermark are dropped, as they can't be told from repeated ones;
    state older than it is let go. A request without a time counts as sent now. Requests
    without an id are told apart by all their fields.
    """
    rest = F.to_json(F.struct(*[F.col(c) for c in requests.columns if c != time]))
    key = F.coalesce(F.concat(F.lit("i"), F.col(id).cast("string")), F.concat(F.lit("r"), F.sha2(rest, 256)))
    timed = requests.withColumns({"_key": key, "_time": F.coalesce(F.col(time).cast("timestamp"), F.current_timestamp())})
    return timed.withWatermark("_time", late).dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_time")


def start_scoring_once(
    requests: DataFrame,
    params_path: str,
    out: str,
    checkpoint: str,
    spec: EncoderSpec = SERVING_SPEC,
    id: str = "id",
    time: str = "sent_at",
    late: str = "1 hour",
    available_now: bool = False,
) -> StreamingQuery:
    """Answer each request once, by the latest parameters published when its batch runs.

    Answers go to ``out`` as Parquet, one ``batch`` partition per micro-batch, with the
    ``version`` of the parameters. A batch that runs again after a failure replaces its
    partition as a whole, so no answer is doubled and one batch holds one version.
    """

    def answer(batch: DataFrame, number: int) -> None:
        version, params = current_params(batch.sparkSession, params_path)
        answers = score_requests(batch, params, spec, id).withColumn("version", F.lit(version).cast("long"))
        answers.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = once(requests, id, time, late).writeStream.foreachBatch(answer).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
