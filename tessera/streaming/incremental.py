"""Merging chunk files as they arrive, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def merge_arrived(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Take every chunk that arrived since the last call through ``stage`` into ``target``.

    Files are tracked in ``checkpoint``, so a call after a failure goes on where the last ended.
    """
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    rows = stage(rows) if stage else rows
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
