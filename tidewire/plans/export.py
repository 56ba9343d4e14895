"""Export jobs: article table, daily sentiment, both event studies, CSV copies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tidewire.operators.aggregates import daily_sentiment, scored_rows
from tidewire.operators.study import event_study_days, event_study_instants
from tidewire.sinks.writers import existing_columns, replace_table, write_csv

TABLES = ("articles", "daily_sentiment_aggregation", "events", "event_analysis")


def analysis_tables(articles: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """The three tables of the calendar-day analysis."""
    rows = scored_rows(articles)
    daily = daily_sentiment(articles)
    return {
        "articles": existing_columns(rows),
        "daily_sentiment_aggregation": daily.withColumn("published_date", daily["published_date"].cast("string")),
        "events": event_study_days(rows, events),
    }


def instant_analysis(articles: DataFrame, events: DataFrame) -> DataFrame:
    """The table of the second study."""
    return event_study_instants(articles, events)


def export_tables(tables: Mapping[str, DataFrame], database: str = "default", folder: str | None = None) -> None:
    for name, df in tables.items():
        replace_table(df, f"{database}.{name}", f"{folder}/{name}" if folder else None)


def export_csv(spark: SparkSession, folder: str, names: Sequence[str] = TABLES, database: str = "default") -> None:
    """CSV copy of each table: one file for the small ones, parts for the articles."""
    for name in names:
        write_csv(spark.table(f"{database}.{name}"), f"{folder}/{name}", single_file=name != "articles")
