"""Daily sentiment and the counters of the quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.dates import parse_timestamp
from tidewire.operators.filters import complete_rows


def scored_rows(articles: DataFrame) -> DataFrame:
    """Articles with score, topic and a readable date, plus ``published_date``."""
    complete = complete_rows(articles, ["sentiment_score", "topic", "published_at"])
    kind = dict(complete.dtypes)["published_at"]
    instant = parse_timestamp(F.col("published_at")) if kind == "string" else F.col("published_at")
    return complete.withColumn("published_date", F.to_date(instant))


def daily_sentiment(articles: DataFrame) -> DataFrame:
    """Mean, sample deviation (0 for a single article) and count per topic and day."""
    dated = scored_rows(articles).filter(F.col("published_date").isNotNull())
    return dated.groupBy("topic", "published_date").agg(
        F.avg("sentiment_score").alias("avg_sentiment"),
        F.coalesce(F.stddev_samp("sentiment_score"), F.lit(0.0)).alias("sentiment_std"),
        F.count("url").alias("article_count"),
    )


def missing(articles: DataFrame) -> Column:
    """Whether an article lacks a score, topic or date."""
    return (
        F.col("sentiment_score").isNull() | F.isnan("sentiment_score")
        | F.col("topic").isNull() | F.col("published_at").isNull()
    )


def dropped_rows(articles: DataFrame) -> DataFrame:
    """One row: how many articles lack a score, topic or date."""
    return articles.agg(F.count("*").alias("initial"), F.count_if(missing(articles)).alias("dropped"))


def articles_per_day(daily: DataFrame) -> DataFrame:
    return daily.groupBy("published_date").agg(F.sum("article_count").alias("article_count"))


def sentiment_rollup(articles: DataFrame) -> DataFrame:
    """(published_date, topic, level, article_count, avg_sentiment, sentiment_std): by day and topic, by day, by topic, and in all.

    What is summed over is null; ``level`` tells it from a null of the data: 0 for both keys, 1 by day, 2 by topic, 3 in all. The articles are reduced to count, mean
    and squared deviations per day and topic; the wider levels are merged from these, by grouping sets over a short table.
    """
    dated = scored_rows(articles).filter(F.col("published_date").isNotNull())
    moments = dated.groupBy("published_date", "topic").agg(
        F.count("*").alias("n"), F.avg("sentiment_score").alias("mean"), (F.count("*") * F.var_pop("sentiment_score")).alias("m2")
    )
    date, topic = F.col("published_date"), F.col("topic")
    merged = moments.groupingSets([[date, topic], [date], [topic], []], date, topic).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("article_count"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("avg_sentiment"),
        F.sum("m2").alias("m2"), F.collect_list(F.struct("n", "mean")).alias("parts"),
    )
    # Around the common mean, so no large squares cancel. A group has at most one part per day and topic.
    between = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["n"] * F.pow(p["mean"] - F.col("avg_sentiment"), 2))
    spread = F.sqrt((F.col("m2") + between) / (F.col("article_count") - 1))
    std = F.when(F.col("article_count") > 1, spread).otherwise(0.0)
    return merged.select("published_date", "topic", "level", "article_count", "avg_sentiment", std.alias("sentiment_std"))
