"""Topic job: vectors, clusters, labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import words
from tidewire.operators.topics import (
    OUTLIER, array_vectors, centre_distance, choose_clusters, distance_limits, drop_outliers, fit_clusters, fit_tfidf, hashed_counts,
    label_topics, number_rows, term_weights, top_terms, topic_labels, topic_numbers, topic_text,
)
from tidewire.session import cut_lineage


def model_topics(
    articles: DataFrame, k: int | Sequence[int] = 20, min_topic_size: int = 2, embedding: str | None = None, seed: int = 42,
    outlier_quantile: float | None = None, outlier_factor: float = 1.5,
) -> DataFrame:
    """Add ``topic_id`` and ``topic``.

    ``embedding`` names a column with the caller's own vectors; otherwise
    hashed TF-IDF of the topic text is clustered. Fewer than two articles are
    all ``Topic_-1``. ``k`` and the outliers by distance are as in ``assign_topics``.
    """
    texts = articles.withColumn("_text", topic_text(F.col("cleaned_body"), F.col("headline")))
    if len(texts.take(2)) < 2:
        return label_topics(texts.withColumn("topic_id", F.lit(OUTLIER)), None).drop("_text")
    # The words and their counts are written once; the fit, the vectors and the topics' terms all start from them.
    narrow = texts.select(words(F.col("_text")).alias("_tokens"), *([embedding] if embedding else []))
    narrow = cut_lineage(narrow if embedding else hashed_counts(narrow))
    vectors_of = partial(array_vectors, array=embedding, out="_vector") if embedding else fit_tfidf(narrow, "_text", out="_vector")
    # Fitting goes over the vectors many times: keep them, not the text they come from.
    vectors = cut_lineage(vectors_of(narrow).select("_vector"))
    model = fit_clusters(vectors, "_vector", k, seed) if isinstance(k, int) else choose_clusters(vectors, k, "_vector", seed)

    def clustered(rows: DataFrame) -> DataFrame:
        found = model.transform(rows)
        if outlier_quantile is None:
            return found
        return drop_outliers(found.withColumn("_distance", centre_distance(model, "_vector")), limits, "_cluster", "_distance").drop("_distance")

    if outlier_quantile is not None:
        away = model.transform(vectors).select("_cluster", centre_distance(model, "_vector").alias("_distance"))
        limits = cut_lineage(distance_limits(away, "_cluster", "_distance", outlier_quantile, outlier_factor))
    # Both lookups have one row per topic and are written, so Spark knows that they are short:
    # the articles get their topics where they are read, without a shuffle of their bodies.
    numbers = cut_lineage(topic_numbers(clustered(vectors), "_cluster", min_topic_size))
    numbered = number_rows(clustered(vectors_of(texts)), numbers, "_cluster").drop("_vector", "_cluster")
    terms = term_weights(number_rows(clustered(vectors_of(narrow)), numbers, "_cluster"), "topic_id", "_tokens")
    labels = topic_labels(top_terms(terms)).filter(F.col("topic") != OUTLIER)
    outlier = labels.sparkSession.range(1).select(F.lit(OUTLIER).alias("topic"), F.lit("Outlier").alias("label"))
    return label_topics(numbered, cut_lineage(labels.unionByName(outlier))).drop("_text")
