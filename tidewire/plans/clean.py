"""Cleaning job: URLs, dates, exact and near duplicates, quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.dates import DATE_FORMATS, normalize_date
from tidewire.functions.minhash import band_keys, minhash_signature
from tidewire.functions.text import word_count
from tidewire.functions.urls import normalize_url
from tidewire.operators.dedup import keep_first
from tidewire.operators.neardup import greedy_keep_first
from tidewire.session import cut_lineage

SHORT_BODY_WORDS = 50


def article_keys(raw: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Narrow facts about each article that all later decisions need, in one pass without a shuffle.

    An unreadable date becomes NULL, an empty one stays empty.
    """
    body = F.coalesce("body", F.lit(""))
    date = F.col("published_at")
    return raw.select(
        "seq",
        normalize_url(F.col("url")).alias("url"),
        F.when(date == "", date).otherwise(normalize_date(date, formats)).alias("published_at"),
        (word_count(body) < SHORT_BODY_WORDS).alias("short"),
        F.when(body != "", band_keys(minhash_signature(body))).alias("bands"),
    )


def first_per_url(keys: DataFrame) -> DataFrame:
    """Articles with a URL, the first of each."""
    return keep_first(keys.filter(F.coalesce("url", F.lit("")) != ""), "url", "seq")


def quality_report(initial: DataFrame, url_pass: DataFrame, kept: DataFrame) -> DataFrame:
    """One row with the six counters. Articles without a body are in none of the duplicate counts."""
    passed = url_pass.agg(
        F.count("*").alias("passed"),
        F.count_if(F.coalesce("published_at", F.lit("")) == "").alias("invalid_dates"),
        F.count_if("short").alias("short_bodies"),
        F.count("bands").alias("with_body"),
    )
    final = kept.agg(F.count("*").alias("f")).scalar()
    total = initial.agg(F.count("*").alias("i")).scalar()
    return passed.select(
        total.alias("initial"),
        (total - F.col("passed")).alias("url_duplicates"),
        (F.col("with_body") - final).alias("body_duplicates"),
        "invalid_dates", "short_bodies",
        final.alias("final"),
    )


def clean_articles(raw: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> tuple[DataFrame, DataFrame]:
    """Cleaned articles and the quality report.

    ``raw`` needs ``seq`` (its input order), ``url``, ``published_at`` and
    ``body``. Bodies are read twice, once for their band keys and once for the
    result, but only the result is shuffled with them: both duplicate decisions
    are made on the narrow keys.
    """
    keys = cut_lineage(article_keys(raw, formats))
    url_pass = cut_lineage(first_per_url(keys))
    kept = greedy_keep_first(url_pass.filter("bands IS NOT NULL").select("seq", "bands"))
    report = quality_report(keys, url_pass, kept)
    clean = url_pass.join(kept, "seq", "left_semi").select("seq", "url", "published_at")
    return raw.drop("url", "published_at").join(clean, "seq"), report
