"""Expressions that turn labels and partial scores into article scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import word_count

MIN_BODY_WORDS = 20
MIN_MODEL_SCORE = 0.001


def signed_label_score(label: Column, score: Column) -> Column:
    """Negative for a label with ``0``, positive with ``2``, else 0 (also when scoring failed)."""
    signed = F.when(F.contains(label, F.lit("0")), -score).when(F.contains(label, F.lit("2")), score)
    return F.coalesce(signed, F.lit(0.0))


def model_score_counts(cleaned: Column, model: Column) -> Column:
    return (word_count(cleaned) >= MIN_BODY_WORDS) & (F.abs(model) > MIN_MODEL_SCORE)


def composite_score(cleaned: Column, model: Column, lexicon: Column) -> Column:
    return F.when(model_score_counts(cleaned, model), model).otherwise(lexicon)
