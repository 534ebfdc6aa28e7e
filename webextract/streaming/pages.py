"""Extraction on a stream. extract() keeps no state from page to page, so the same plan runs on a streaming table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from webextract.options import Options
from webextract.plans.extract import extract


def read_page_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of pages (page_id, url, html) in a folder."""
    return spark.readStream.schema("page_id bigint, url string, html string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def extract_stream(pages: DataFrame, out: str, checkpoint: str, options: Options | None = None, once: bool = False) -> StreamingQuery:
    """Results as Parquet, exactly once for each page by Spark's checkpoint. once: what is there now, then an end."""
    writer = extract(pages, options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
