"""Following a folder: new rows are inserted into a table as they come, and tables that compute from it are filled after each
batch. What a batch inserts is committed with the batch's number, so a batch that is tried again changes nothing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.tables import Table
from .populate import AutoPopulate


def follow(spark: SparkSession, folder: str, schema: StructType, target: Table, checkpoint: str, then: Iterable[AutoPopulate] = (), format: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Start the query. available_now ends it when all files that are there have been taken; else it goes on waiting for more."""
    later = list(then)

    def batch(rows: DataFrame, number: int) -> None:
        name = f"streams/{target.full_name}/{number:012d}"
        store = target.catalog.store
        target.catalog.refresh()
        if not store.exists(name):
            # keys that are there already are skipped, which also covers a batch that was inserted but not marked
            target.insert(rows, skip_duplicates=True, ignore_extra_fields=True)
            store.write(name, b"done")
        for t in later:
            t.populate(suppress_errors=True)

    source = spark.readStream.format(format).schema(schema).load(folder)
    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
