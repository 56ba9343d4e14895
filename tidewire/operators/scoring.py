"""Model scoring of a text column, with the model supplied by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import clean_tokens, is_blank
from tidewire.session import cut_lineage, scratch_path

MODEL_INPUT_CHARS = 2000

BatchScorer = Callable[[list[str]], list[tuple[str, float]]]


def model_input(body: Column, max_chars: int | None = MODEL_INPUT_CHARS) -> Column:
    """What the model sees: the first characters of the raw body (its input limit), or all of it if the limit is None."""
    return body if max_chars is None else F.substring(body, 1, max_chars)


def batch_label_score(text: Column, make_scorer: Callable[[], BatchScorer]) -> Column:
    """struct(label, score) of ``text``; both NULL where the text is NULL or scoring fails.

    ``make_scorer`` runs once per task and returns the function that scores a
    list of texts. If a batch fails its texts are tried one at a time, so only
    the texts at fault end up without a score.
    """

    @F.pandas_udf("label string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()

        def one(t: str) -> tuple:
            try:
                return scorer([t])[0]
            except Exception:
                return (None, None)

        for batch in batches:
            known = batch.notna().tolist()
            texts = batch[known].tolist()
            try:
                results = scorer(texts) if texts else []
            except Exception:
                results = [one(t) for t in texts]
            found = iter(results)
            pairs = [next(found) if k else (None, None) for k in known]
            yield pd.DataFrame({"label": [p[0] for p in pairs], "score": pd.Series([p[1] for p in pairs], dtype="float64")})

    return score(text)


def scorable(cleaned: Column, body: Column, max_chars: int | None = MODEL_INPUT_CHARS) -> Column:
    """Model input, or NULL when nothing is left of the body after cleaning."""
    return F.when(~is_blank(cleaned), model_input(body, max_chars))


def default_scorer(
    labelled: DataFrame, text: str, label: str, features: int = 1 << 14, max_chars: int | None = None,
) -> PipelineModel:
    """Hashed TF-IDF and logistic regression, trained on (text, 0/1 label) rows; texts are read whole without ``max_chars``."""
    train = labelled.select(
        clean_tokens(model_input(F.col(text), max_chars)).alias("tokens"), F.col(label).cast("double").alias("target")
    )
    # Two estimators read the tokens, one of them many times: clean the texts once.
    train = cut_lineage(train)
    stages = [
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="target", maxIter=20, regParam=0.01),
    ]
    # A fitted model holds on to the session by its summary, which no task can be sent once the session has observed
    # a write. The model read back has none.
    path = scratch_path(labelled.sparkSession, "model")
    Pipeline(stages=stages).fit(train).write().save(path)
    return PipelineModel.load(path)


def apply_default_scorer(model: PipelineModel, df: DataFrame, text: str) -> DataFrame:
    """Add ``label`` (LABEL_0 or LABEL_2) and ``score``, the probability of that label."""
    fed = df.withColumn("tokens", clean_tokens(F.coalesce(F.col(text), F.lit(""))))
    out = model.transform(fed)
    p = F.get(vector_to_array("probability"), F.lit(1))
    known = F.col(text).isNotNull()
    return (
        out.withColumn("label", F.when(known, F.when(p >= 0.5, "LABEL_2").otherwise("LABEL_0")))
        .withColumn("score", F.when(known, F.greatest(p, 1 - p)))
        .drop("tokens", "tf", "features", "rawPrediction", "probability", "prediction")
    )
