"""Incremental ingest of feed files: each file once, each URL once, restartable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators.dedup import keep_first
from tidewire.operators.filters import is_web_url, mentions_either
from tidewire.sinks.store import SHARDS, UrlStore
from tidewire.sources.archives import stream_archives
from tidewire.sources.gkg import article_columns, parse_lines

LINE = T.StructType([T.StructField("value", T.StringType())])
ARTICLE = "file string, url string, source string, headline string, published_at string, scrape_at string, body string, themes string"


def line_stream(spark: SparkSession, src: str, files_per_batch: int = 1000) -> DataFrame:
    raw = spark.readStream.schema(LINE).option("maxFilesPerTrigger", files_per_batch).format("text").load(src)
    return raw.withColumn("file", F.col("_metadata.file_name"))


def archive_line_stream(spark: SparkSession, src: str) -> DataFrame:
    """Lines of zipped feed files, each archive once as it lands."""
    return stream_archives(spark, src).select("value", F.substring_index("path", "/", -1).alias("file"))


def relevant_articles(lines: DataFrame, relevant: Callable = mentions_either, scraped_at=None) -> DataFrame:
    """Articles of the relevant web URLs among feed lines, with the name of their file."""
    rows = parse_lines(lines).filter(is_web_url(F.col("url")) & relevant(F.col("themes"), F.col("url")))
    record = article_columns(scraped_at, with_tone=False)
    return rows.select("file", *[c.alias(name) for name, c in record.items()])


def ingest_stream(
    spark: SparkSession, src: str, dst: str, checkpoint: str, scraped_at=None, relevant: Callable = mentions_either,
    zipped: bool = False, shards: int = SHARDS,
) -> StreamingQuery:
    """Add the new articles of all files, or archives if ``zipped``, not read yet to the store at ``dst`` and stop.

    Every batch is a batch of the store: it looks for its URLs in their shards of earlier batches alone, and repeated
    after a failure it replaces itself.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        fresh = keep_first(batch, "url", "file", "published_at", "source", "themes")
        UrlStore(batch.sparkSession, dst, shards).append(fresh, batch_id)

    lines = archive_line_stream(spark, src) if zipped else line_stream(spark, src)
    return (
        relevant_articles(lines, relevant, scraped_at).writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ingested(spark: SparkSession, dst: str, shards: int = SHARDS) -> DataFrame:
    """The articles a stream has added so far."""
    return UrlStore(spark, dst, shards).read(ARTICLE, recorded=False)


def bounded_stream(lines: DataFrame, slot_time, delay: str = "1 day") -> DataFrame:
    """Each URL once within ``delay``: the form whose state does not grow for ever.

    ``slot_time`` is the event time of a line, usually parsed from its file name.
    """
    rows = relevant_articles(lines).withColumn("slot_time", slot_time)
    return rows.withWatermark("slot_time", delay).dropDuplicatesWithinWatermark(["url"])
