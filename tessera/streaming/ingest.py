"""Incremental ingestion: what is new since the last run, once, with Structured Streaming or a batch anti-join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def ingest_available(spark: SparkSession, source: str, schema: StructType, checkpoint: str, apply: Callable[[DataFrame], DataFrame], sink: str, files_per_batch: int = 1000) -> None:
    """Appends ``apply`` of all files that came since the checkpoint to a Parquet table, then stops."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = apply(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(sink)
    query.awaitTermination()


def ingest_batches(spark: SparkSession, source: str, schema: StructType, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 1000) -> None:
    """As above with a handler for each micro-batch, for upkeep that joins the stored tables."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
