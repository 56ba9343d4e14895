"""Text and sentiment job: a pass over the articles without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire import defaults
from tidewire.functions.scores import composite_score, signed_label_score
from tidewire.functions.text import clean_text
from tidewire.operators.lexicon import lexicon_score
from tidewire.operators.scoring import MODEL_INPUT_CHARS, BatchScorer, apply_default_scorer, batch_label_score, scorable


def score_articles(
    articles: DataFrame,
    scorer: PipelineModel | Callable[[], BatchScorer],
    lexicon: Mapping[str, float] = defaults.LEXICON,
    stopwords: Sequence[str] = defaults.STOPWORDS,
    lemmas: Mapping[str, str] = defaults.LEMMAS,
    max_chars: int | None = MODEL_INPUT_CHARS,
) -> DataFrame:
    """Add ``cleaned_body``, ``vader_score``, ``transformer_score`` and ``sentiment_score``.

    ``scorer`` is a fitted Spark model (see ``default_scorer``) or a function
    that makes a batch scorer inside each task. ``max_chars`` is the input limit
    of such a batch scorer, None for whole texts; a Spark model reads whole texts.
    """
    limit = None if isinstance(scorer, PipelineModel) else max_chars
    prepared = articles.withColumn("cleaned_body", clean_text(F.col("body"), stopwords, lemmas)).withColumns({
        "vader_score": lexicon_score(F.col("headline"), lexicon),
        "model_input": scorable(F.col("cleaned_body"), F.col("body"), limit),
    })
    if isinstance(scorer, PipelineModel):
        labelled = apply_default_scorer(scorer, prepared, "model_input")
    else:
        labelled = prepared.withColumn("_r", batch_label_score(F.col("model_input"), scorer))
        labelled = labelled.withColumns({"label": F.col("_r.label"), "score": F.col("_r.score")}).drop("_r")
    scored = labelled.withColumn("transformer_score", signed_label_score(F.col("label"), F.col("score")))
    final = composite_score(F.col("cleaned_body"), F.col("transformer_score"), F.col("vader_score"))
    return scored.withColumn("sentiment_score", final).drop("model_input", "label", "score")
