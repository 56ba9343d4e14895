"""Toxicity by boosted trees over dense features, calibrated isotonically (operator 2)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.sampling import held_out, labelled_sample
from tidewire.llm.tasks import map_rows
from tidewire.llm.trees import Forest, Isotonic, fit_forest, fit_isotonic
from tidewire.session import cut_lineage

SAMPLE_ROWS = 8000  # labelled rows that are learned from, at most
STEMS = 2000  # entries of the learned lexicon, at most
STEM_ROWS = 6  # toxic rows that an entry needs
STEM_ODDS = 3.0  # log of how much more often it must occur in toxic rows
THRESHOLD = 0.7
NEAR = 6  # words to either side in which an address counts as near

# A starter list of insults and of words that address the reader.
INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass loser losers scum trash garbage worthless pathetic disgusting "
    "clown fool imbecile retard retarded bastard bitch whore slut asshole jerk freak creep pig vermin filth parasite cretin "
    "dummkopf trottel arschloch schlampe abschaum connard salope imbécile abruti ordure idiota estúpido imbécil basura puta".split()
)
ADDRESS = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre tú ti tus usted ustedes".split())
WORD = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"[^\W\d_]+[0-9@$*!]+[^\W\d_]+")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
FEATURES = 16


def stems(word: str) -> tuple[str, str, str]:
    """The forms under which a word is looked up: itself and its beginnings."""
    return word, word[:5] + "-", word[:4] + "-"


def features(text: str, learned: frozenset[str]) -> list[float]:
    """The dense features of one whole text; an empty one has zeros."""
    words = WORD.findall(text.lower())
    n, chars = max(len(words), 1), max(len(text), 1)
    listed = [i for i, w in enumerate(words) if w in INSULTS]
    known = [i for i, w in enumerate(words) if w in learned or w[:5] + "-" in learned or w[:4] + "-" in learned] if learned else []
    disguised = [m.translate(PLAIN) for m in DISGUISED.findall(text.lower())]
    address = [i for i, w in enumerate(words) if w in ADDRESS]
    hits = sorted({*listed, *known})
    places, near = np.array(address), 0
    if len(places) and hits:
        at = np.searchsorted(places, hits)
        left = np.abs(places[np.maximum(at - 1, 0)] - hits)
        right = np.abs(places[np.minimum(at, len(places) - 1)] - hits)
        near = int((np.minimum(left, right) <= NEAR).sum())
    crowd = max((hits[min(i + 4, len(hits) - 1)] - h for i, h in enumerate(hits)), default=0)
    letters = max(sum(map(len, words)), 1)
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    marks = text.count("!"), text.count("?"), text.count("*") + text.count("#") + text.count("$") + text.count("%") + text.count("&")
    return [
        100 * len(listed) / n, 100 * len(known) / n, math.log1p(len(listed)), math.log1p(len(known)),
        len({words[i] for i in hits}), near / n * 100, near / max(len(hits), 1), 100 * len(address) / n,
        capitals / letters, *(100 * m / chars for m in marks), 100 * len(disguised) / n,
        float(sum(d in INSULTS for d in disguised)), 100 * len(STRETCHED.findall(text)) / n, crowd / n,
    ]


@dataclass
class Model:
    """A fitted scorer; ``constant`` stands in where the labels do not have both classes."""

    learned: frozenset[str]
    forest: Forest | None
    calibration: Isotonic | None
    constant: float = 0.0

    def score(self, texts: list[str]) -> np.ndarray:
        if self.forest is None:
            return np.full(len(texts), self.constant)
        x = np.array([features(t or "", self.learned) for t in texts]).reshape(len(texts), FEATURES)
        return np.clip(self.calibration(self.forest.raw(x)), 0.0, 1.0)


def learn_stems(sample: DataFrame) -> frozenset[str]:
    """Words and beginnings of words that labelled toxic rows have far more often than the others."""

    def run(batches):
        for texts, labels in batches:
            found, marks = [], []
            for text, label in zip(texts, labels, strict=True):
                own = {s for w in set(WORD.findall(text.lower())) for s in stems(w) if len(w) > 3}
                found += own
                marks += [label] * len(own)
            yield [found, marks]

    ones, rows = sample.agg(F.sum("label"), F.count("*")).first()
    counts = map_rows(sample.select("text", "label"), run, "stem string, label int").groupBy("stem").agg(F.sum("label").alias("toxic"), F.count("*").alias("all"))
    clean = (F.col("all") - F.col("toxic") + 0.5) / F.lit(rows - ones + 1)
    odds = F.log((F.col("toxic") + 0.5) / F.lit(ones + 1)) - F.log(clean)
    best = counts.withColumn("odds", odds).filter((F.col("toxic") >= STEM_ROWS) & (F.col("odds") >= STEM_ODDS))
    return frozenset(r["stem"] for r in best.orderBy(F.desc("odds"), "stem").limit(STEMS).collect())


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``rows`` labelled rows outside the held-out part.

    Lexicon and trees come from three quarters of them, the calibration from the rest.
    """
    sample = cut_lineage(labelled_sample(docs, labels, doc_id, text, label, rows))
    seen = {r["label"] for r in sample.filter("fold < 3").select("label").distinct().collect()}
    if seen != {0, 1}:
        return Model(frozenset(), None, None, 1.0 if seen == {1} else 0.0)
    learned = learn_stems(sample.filter("fold < 3"))

    def run(batches):
        for texts, marks, folds in batches:
            yield [[features(t, learned) for t in texts], marks, folds]

    table = map_rows(sample.select("text", "label", "fold"), run, "x array<double>, label int, fold int").collect()
    x, y, fold = np.array([r["x"] for r in table]), np.array([r["label"] for r in table], float), np.array([r["fold"] for r in table])
    order = np.lexsort((y, fold, *x.T))  # rows arrive in any order; sums then come out the same each time
    x, y, fold = x[order], y[order], fold[order]
    forest = fit_forest(x[fold < 3], y[fold < 3])
    rest = fold == 3 if len(set(y[fold == 3])) == 2 else fold < 4
    return Model(learned, forest, fit_isotonic(forest.raw(x[rest]), y[rest]))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null texts count as empty."""

    def run(batches):
        for ids, texts in batches:
            yield [ids, model.score(texts)]

    scored = map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text)), run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        return pd.Series(model.score(texts.tolist()) < threshold)

    return docs.filter(clean(F.col(text)))
