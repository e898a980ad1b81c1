"""An extension: summaries of records that keep running while records come, over streams that may be stopped and may deliver a file twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def running(records: DataFrame, key: list[str], summary: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Keeps `out` at summary(all records so far), each key counted once however often its record comes (its first one counts). What was seen and the sums lie in the checkpoint's state, so a stopped query goes on where it was,
    and a repeated batch writes the same table again. State grows by a key for each record."""
    summed = summary(records.dropDuplicates(key))
    return summed.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
