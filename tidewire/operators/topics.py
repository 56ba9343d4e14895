"""Topics: text choice, document vectors, clusters, top words, labels."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.text import is_blank, words
from tidewire.operators.hotkeys import join_per_key
from tidewire.session import cut_lineage

OUTLIER = -1
DISTANCE_ROWS = 1024


def topic_text(cleaned: Column, headline: Column) -> Column:
    """Cleaned body, or the headline when nothing is left of the body."""
    return F.when(~is_blank(cleaned), cleaned).otherwise(F.coalesce(headline, F.lit("")))


def hashed_counts(df: DataFrame, features: int = 1 << 12) -> DataFrame:
    """Add ``_tf``: how often each hash occurs among ``_tokens``."""
    return HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features).transform(df)


def fit_tfidf(df: DataFrame, text: str, features: int = 1 << 12, out: str = "vector") -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``out``, hashed TF-IDF of unit length, in a map-side pass. One pass of counts is fitted.

    Where there is a column ``_tf`` it has the counts of ``hashed_counts``, and the text is not looked at again.
    """
    unit = Normalizer(inputCol="_tfidf", outputCol=out)

    def counted(rows: DataFrame) -> DataFrame:
        return rows if "_tf" in rows.columns else hashed_counts(rows.withColumn("_tokens", words(F.col(text))), features)

    scale = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted(df))
    return lambda rows: unit.transform(scale.transform(counted(rows))).drop("_tfidf", *({"_tf", "_tokens"} - set(rows.columns)))


def tfidf_vectors(df: DataFrame, text: str, features: int = 1 << 12) -> DataFrame:
    """Add ``vector``: hashed TF-IDF of unit length, fitted on ``df`` itself."""
    return fit_tfidf(df, text, features)(df)


def term_vectors(df: DataFrame, doc: str, tokens: str) -> DataFrame:
    """(doc, term, weight): TF-IDF on the terms themselves, tf * ln((N + 1) / (n + 1)) for a term of n of N rows.

    The hashed vectors weigh alike but may let terms collide. A term that most
    texts have is joined apart from the others.
    """
    counts = cut_lineage(df.select(doc, F.explode(tokens).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf")))
    spread = counts.groupBy("term").agg(F.count("*").alias("n"))
    weight = F.col("tf") * F.log(F.lit(df.count() + 1) / (F.col("n") + 1))
    return join_per_key(counts, spread, "term", "n").select(doc, "term", weight.alias("weight"))


def array_vectors(df: DataFrame, array: str, out: str = "vector") -> DataFrame:
    """Add ``out`` from the caller's own embedding column."""
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def topic_numbers(df: DataFrame, cluster: str, min_topic_size: int = 2) -> DataFrame:
    """(cluster, topic_id): 0, 1, 2 ... by falling size, for clusters that are large enough.

    The ranking runs over one row per cluster.
    """
    sizes = df.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(W.orderBy(F.desc("_n"), cluster)) - 1
    return sizes.filter(F.col("_n") >= min_topic_size).select(cluster, rank.alias("topic_id"))


def number_rows(df: DataFrame, numbers: DataFrame, cluster: str) -> DataFrame:
    """Add ``topic_id`` from ``numbers``; -1 for NULL or unnumbered clusters."""
    return df.join(numbers, cluster, "left").withColumn("topic_id", F.coalesce("topic_id", F.lit(OUTLIER)))


def number_topics(df: DataFrame, cluster: str, min_topic_size: int = 2) -> DataFrame:
    """Add ``topic_id``: 0, 1, 2 ... by falling size; -1 for NULL or too small clusters."""
    return number_rows(df, topic_numbers(df, cluster, min_topic_size), cluster)


def choose_clusters(vectors: DataFrame, counts: Sequence[int], vector: str = "vector", seed: int = 42, worth: float = 2.0) -> KMeansModel:
    """The model with the least penalised cost, cost times ``worth`` to the number of clusters: of those in ``counts``.

    One more cluster must divide the cost by more than ``worth``. All models are fitted on the same written vectors.
    """
    models = [fit_clusters(vectors, vector, k, seed) for k in counts]
    return min(models, key=lambda m: (math.log(max(m.summary.trainingCost, 1e-300)) + len(m.clusterCenters()) * math.log(worth), len(m.clusterCenters())))


def centre_distance(model: KMeansModel, vector: str = "vector", cluster: str = "_cluster") -> Column:
    """How far a vector is from the centre of its cluster, computed on Arrow batches."""
    centres = np.array([c for c in model.clusterCenters()], dtype=np.float64)

    @F.arrow_udf("double")
    def distance(values: pa.Array, own: pa.Array) -> pa.Array:
        rows = np.asarray(values.flatten(), dtype=np.float64).reshape(-1, centres.shape[1])
        out = np.empty(len(rows))
        for i in range(0, len(rows), DISTANCE_ROWS):
            part = slice(i, i + DISTANCE_ROWS)
            out[part] = np.sqrt(((rows[part] - centres[np.asarray(own[i : i + DISTANCE_ROWS])]) ** 2).sum(axis=1))
        return pa.array(out)

    return distance(vector_to_array(F.col(vector), "float32"), F.col(cluster))


def distance_limits(df: DataFrame, cluster: str, distance: str, quantile: float, factor: float) -> DataFrame:
    """(cluster, limit): ``factor`` times the distance that the ``quantile`` of a cluster's members do not exceed.

    The quantile is taken from mergeable summaries; one row per cluster comes out.
    """
    return df.groupBy(cluster).agg((F.percentile_approx(distance, quantile, 100_000) * factor).alias("_limit"))


def drop_outliers(df: DataFrame, limits: DataFrame, cluster: str, distance: str) -> DataFrame:
    """NULL in place of the cluster of members beyond its limit. Limits have one row per cluster."""
    inside = F.coalesce(F.col(distance) <= F.col("_limit"), F.lit(True))
    return df.join(F.broadcast(limits), cluster, "left").withColumn(cluster, F.when(inside, F.col(cluster))).drop("_limit")


class OneCluster:
    """All vectors in one cluster, which k-means cannot be asked for."""

    def __init__(self, df: DataFrame, vector: str):
        self.centre = df.select(Summarizer.mean(F.col(vector))).first()[0].toArray()

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_cluster", F.lit(0))

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802
        return [self.centre]


def fit_clusters(df: DataFrame, vector: str = "vector", k: int = 20, seed: int = 42) -> KMeansModel | OneCluster:
    if k == 1:
        return OneCluster(df, vector)
    return KMeans(featuresCol=vector, predictionCol="_cluster", k=k, seed=seed, maxIter=10).fit(df)


def assign_topics(
    df: DataFrame, vector: str = "vector", k: int | Sequence[int] = 20, min_topic_size: int = 2, seed: int = 42,
    outlier_quantile: float | None = None, outlier_factor: float = 1.5,
) -> DataFrame:
    """Cluster the vectors and number the clusters; fewer than two rows are all outliers.

    Of several numbers ``k`` of clusters the one of least penalised cost is taken. With ``outlier_quantile`` a member is
    an outlier, with topic -1, if it is farther from its centre than ``outlier_factor`` times that quantile of its cluster.
    """
    if len(df.select(vector).take(2)) < 2:
        return df.withColumn("topic_id", F.lit(OUTLIER))
    model = fit_clusters(df, vector, k, seed) if isinstance(k, int) else choose_clusters(cut_lineage(df.select(vector)), k, vector, seed)
    found = model.transform(df)
    if outlier_quantile is not None:
        found = cut_lineage(found.withColumn("_distance", centre_distance(model, vector)))
        limits = distance_limits(found, "_cluster", "_distance", outlier_quantile, outlier_factor)
        found = drop_outliers(found, limits, "_cluster", "_distance").drop("_distance")
    return number_topics(found, "_cluster", min_topic_size).drop("_cluster")


def topic_sizes(df: DataFrame, topic: str = "topic_id") -> DataFrame:
    return df.groupBy(topic).agg(F.count("*").alias("n"))


def term_weights(df: DataFrame, topic: str, tokens: str) -> DataFrame:
    """(topic, term, tf, weight): class-based TF-IDF, tf * ln(1 + A / f).

    f counts the term over all topics, A is the mean number of tokens per
    topic. Counts are combined on the map side; from there on there is one row
    per topic and term. They are needed three times, so they are written.
    """
    counts = cut_lineage(
        df.select(F.col(topic).alias("topic"), F.explode(tokens).alias("term"))
        .groupBy("topic", "term").agg(F.count("*").alias("tf"))
    )
    overall = counts.groupBy("term").agg(F.sum("tf").alias("f"))
    mean = counts.agg(F.try_divide(F.sum("tf"), F.count_distinct("topic"))).scalar()
    weight = F.col("tf") * F.log1p(mean / F.col("f"))
    return counts.join(overall, "term").select("topic", "term", "tf", weight.alias("weight"))


def top_terms(weights: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` heaviest terms of each topic, with their rank; ties go by term."""
    rank = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("weight"), "term"))
    return weights.withColumn("rank", rank).filter(F.col("rank") <= k)


def topic_labels(top: DataFrame) -> DataFrame:
    """(topic, label): ``Topic_<id>_<w1>_<w2>_<w3>``, or ``Outlier``. At most k terms per topic meet."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"])
    name = F.concat_ws("_", F.lit("Topic"), F.col("topic").cast("string"), F.array_join("terms", "_"))
    return top.groupBy("topic").agg(ordered.alias("terms")).select(
        "topic", F.when(F.col("topic") == OUTLIER, "Outlier").otherwise(name).alias("label")
    )


def label_topics(df: DataFrame, labels: DataFrame | None, topic: str = "topic_id") -> DataFrame:
    """Add ``topic``: the label of the id; ``Unknown`` without one, ``Topic_<id>`` without any labels.

    There is one label per topic, which Spark may broadcast after measuring it.
    """
    if labels is None:
        return df.withColumn("topic", F.concat(F.lit("Topic_"), F.col(topic).cast("string")))
    named = labels.select(F.col("topic").alias("_id"), F.col("label").alias("topic"))
    joined = df.join(named, F.col(topic) == F.col("_id"), "left").drop("_id")
    return joined.withColumn("topic", F.coalesce("topic", F.lit("Unknown")))
