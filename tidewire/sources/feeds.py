"""Landed answers of the two news feeds, one JSON document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import schemas


def _articles(responses: DataFrame, body: str, schema) -> DataFrame:
    rest = [c for c in responses.columns if c != body]
    parsed = responses.select(*rest, F.from_json(F.col(body), schema)["articles"].alias("_articles"))
    return parsed.select(*rest, F.posexplode("_articles").alias("pos", "_a")).select(*rest, "pos", "_a.*")


def feed_a_articles(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row per listed article; an answer without a list gives none."""
    return _articles(responses, body, schemas.FEED_A)


def feed_b_articles(responses: DataFrame, body: str = "body") -> DataFrame:
    return _articles(responses, body, schemas.FEED_B)


def publisher_name(source: Column) -> Column:
    """Name inside the publisher object, ``Unknown`` when there is no object."""
    return F.when(source.isNotNull(), source["name"]).otherwise(F.lit("Unknown"))


def _stamp(scraped_at: Column | None) -> Column:
    at = F.current_timestamp() if scraped_at is None else scraped_at
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("scrape_at")


def feed_a_records(articles: DataFrame, *keep: str, scraped_at: Column | None = None) -> DataFrame:
    return articles.select(
        *keep, "url", F.col("domain").alias("source"), F.col("title").alias("headline"),
        F.col("seendate").alias("published_at"), _stamp(scraped_at),
    )


def feed_b_records(articles: DataFrame, *keep: str, scraped_at: Column | None = None) -> DataFrame:
    return articles.select(
        *keep, "url", publisher_name(F.col("source")).alias("source"), F.col("title").alias("headline"),
        F.col("publishedAt").alias("published_at"), _stamp(scraped_at),
    )
