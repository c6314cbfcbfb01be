"""Incremental ingestion: a file stream of pages into page records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sievework.operators.pages import page_records, parsed_pages

PAGES = "page_id long, url string, html string"


def page_stream(spark: SparkSession, folder: str, schema: str | StructType = PAGES, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def new_pages(stream: DataFrame) -> DataFrame:
    """Each URL once: the state store remembers what was seen, also over restarts."""
    return stream.dropDuplicates(["url"])


def record_stream(stream: DataFrame) -> DataFrame:
    """Records of the stream's pages, with the time of their batch."""
    return page_records(parsed_pages(new_pages(stream)), scraped_at=F.current_timestamp())


def refresh(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Handles what is there now and stops; run it on a schedule. ``sink`` gets each batch and its number."""
    return record_stream(stream).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
