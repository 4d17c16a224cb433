"""The same plans over streams: row expressions need no state, so a stream's result is the batch's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stream_of(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream with the schema of ``like``; all files that are there make one batch, or ``files_per_trigger`` of them."""
    reader = spark.readStream.schema(like.schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def run_available(
    stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, timeout_s: int | None = None
) -> None:
    """Applies ``plan`` to all that is there and writes Parquet; a restart goes on where the checkpoint stands.

    It takes as long as it takes, unless ``timeout_s`` is given; then it is stopped, and the checkpoint stays.
    """
    query = (
        plan(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream has not ended after {timeout_s} s")
