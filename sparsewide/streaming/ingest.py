"""Append and flush as a stream: each micro-batch goes to the table in one atomic append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalog import Table


def append_stream(source: DataFrame, table: Table, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes a streaming frame, conformed to the table, to Parquet at `path`; file commits make it exactly-once."""
    writer = table.conform(source).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
