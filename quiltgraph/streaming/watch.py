"""Watching a folder of records: file-source micro-batches that publish a new graph generation each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def watched(spark: SparkSession, path: str, schema: StructType, publish: Callable[[DataFrame, int], None], checkpoint: str, files_a_batch: int = 1000, once: bool = True) -> StreamingQuery:
    """Starts a stream over new JSON files in ``path``; ``publish`` gets each batch and its number.

    Batches come one at a time; a batch that fails is tried again from the checkpoint, and until then
    readers keep the last generation. ``once`` takes what is there and ends.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)
    q = source.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime="200 milliseconds")).start()


def appending(store, build: Callable[[DataFrame], object]) -> Callable[[DataFrame, int], None]:
    """A publisher that appends the graph built from each batch to a store; replayed batches change nothing."""

    def publish(batch: DataFrame, number: int) -> None:
        head = store.head()
        if head is not None and head.get("batch", -1) >= number:
            return
        if not batch.isEmpty():
            store.write(build(batch), mode="append", told={"batch": number})

    return publish
