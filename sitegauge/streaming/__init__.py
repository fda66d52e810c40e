"""Audits of pages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitegauge.operators import rules


def page_stream(spark: SparkSession, folder: str, schema: str = "page_id bigint, url string, host string, html string, ingested_at timestamp") -> DataFrame:
    """Pages from Parquet files that land in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def first_fetches(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Each page once, however often it is delivered within the watermark."""
    return stream.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["page_id"])


def audit_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the findings of new pages to Parquet files; ends when nothing is left to read."""
    found = rules.findings(first_fetches(stream).select("page_id", "html"))
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def hourly_arrivals(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """``hour, host, n_pages`` in tumbling hours of arrival, late rows within the watermark counted."""
    return stream.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", "1 hour").alias("hour"), "host").agg(F.count("*").alias("n_pages"))
