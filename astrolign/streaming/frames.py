"""An extension: the image source and the solving job on streams of files. Frames are independent, so decoding keeps no state; solving runs on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def files(spark: SparkSession, path: str) -> DataFrame:
    """New *.fits files of a folder as they come."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.fits").load(path)


def each_batch(stream: DataFrame, job: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs job on every micro-batch and writes its rows to a folder of the batch's number, so that a repeated batch replaces its own rows."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: job(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
