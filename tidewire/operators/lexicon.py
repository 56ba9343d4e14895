"""Lexicon sentiment: word valences adjusted by nearby words and by emphasis.

The rule follows Hutto & Gilbert (2014): degree words and negations among the
three preceding words, capitals, "but", exclamation and question marks. The
sum s of a text becomes s / sqrt(s^2 + 15).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import defaults
from tidewire.functions.lookup import bind, dict_lookup
from tidewire.functions.text import words
from tidewire.operators.wordtables import word_values

# Fixed values of the published rule.
NEGATION = -0.74
DAMPING = (1.0, 0.95, 0.9)
CAPITALS = 0.733
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MAX_QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96
NORMALIZER = 15.0

_EDGE_PUNCTUATION = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z"


def bare_words(text: Column) -> Column:
    """White-space words without edge punctuation; words of one or two letters stay as they are."""

    def bare(ws: Column) -> Column:
        inner = F.transform(ws, lambda w: F.regexp_replace(w, _EDGE_PUNCTUATION, ""))
        return F.zip_with(ws, inner, lambda w, i: F.when(F.length(i) <= 2, w).otherwise(i))

    return bind(words(text), bare)


def tokens_in_context(text: Column) -> Column:
    """Array of (pos, token, prev1, prev2, prev3): each word with the three before it."""

    def in_context(tokens: Column) -> Column:
        # Whole arrays are shifted and zipped, which is cheaper than a lookup for each word and place.
        n, none = F.size(tokens), F.lit(None).cast("string")
        pos = F.slice(F.sequence(F.lit(0), n), F.lit(1), n)
        before = [F.slice(F.concat(F.array(*[none] * k), tokens), F.lit(1), n) for k in (1, 2, 3)]
        return F.arrays_zip(pos, tokens, *before).cast("array<struct<pos:int,token:string,prev1:string,prev2:string,prev3:string>>")

    return bind(bare_words(text), in_context)


def _shouted(w: Column) -> Column:
    return (w == F.upper(w)) & (w != F.lower(w))


def lexicon_score(
    text: Column,
    lexicon: Mapping[str, float] | Column = defaults.LEXICON,
    boosters: Mapping[str, float] = defaults.BOOSTERS,
    negations: Sequence[str] = defaults.NEGATIONS,
    places: int = 4,
) -> Column:
    """Compound score in [-1, 1] of one text.

    Everything happens inside the row: no shuffle, and the lexicon travels with
    the plan as a constant. In its place a map column may have the entries of the words of the row, see ``score_by_table``.
    """
    negations = list(negations)

    def valence(word: Column) -> Column:
        return F.try_element_at(lexicon, word) if isinstance(lexicon, Column) else dict_lookup(word, lexicon, "double")

    def step(tokens: Column, mixed: Column, i: Column, v: Column, k: Column) -> Column:
        word = F.get(tokens, i - k)
        low = F.lower(word)
        known = valence(low).isNotNull()
        push = F.coalesce(dict_lookup(low, boosters, "double"), F.lit(0.0))
        push = push + F.when(mixed & _shouted(word) & (push != 0), CAPITALS).otherwise(0.0)
        damp = F.when(k == 1, DAMPING[0]).when(k == 2, DAMPING[1]).otherwise(DAMPING[2])
        flip = F.when(low.isin(negations) | F.contains(low, F.lit("n't")), NEGATION).otherwise(1.0)
        return F.when(word.isNull() | known, v).otherwise((v + F.signum(v) * push * damp) * flip)

    def adjusted(tokens: Column, mixed: Column, but_at: Column, w: Column, i: Column) -> Column:
        low = F.lower(w)
        plain = F.when(low.isin(list(boosters)), 0.0).otherwise(valence(low))
        side = F.when((but_at < 0) | (i == but_at), 1.0).when(i < but_at, BEFORE_BUT).otherwise(AFTER_BUT)

        def nearby(v: Column) -> Column:
            start = v + F.when(mixed & _shouted(w), F.signum(v) * CAPITALS).otherwise(0.0)
            three = F.sequence(F.lit(1), F.lit(3))
            after = F.aggregate(three, start, lambda acc, k: step(tokens, mixed, i, acc, k))
            return F.when(F.coalesce(v, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(after * side)

        return bind(plain, nearby)

    def sum_of(tokens: Column) -> Column:
        shouts = F.size(F.filter(tokens, _shouted))
        facts = F.struct(
            ((shouts > 0) & (shouts < F.size(tokens))).alias("mixed"),
            (F.array_position(F.transform(tokens, F.lower), "but") - 1).alias("but_at"),
        )

        def add_up(f: Column) -> Column:
            values = F.transform(tokens, lambda w, i: adjusted(tokens, f["mixed"], f["but_at"], w, i))
            return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

        return bind(facts, add_up)

    total = bind(bare_words(text), sum_of)
    filled = F.coalesce(text, F.lit(""))
    bangs = F.least(F.length(filled) - F.length(F.replace(filled, F.lit("!"))), F.lit(MAX_EXCLAMATIONS))
    asks = F.length(filled) - F.length(F.replace(filled, F.lit("?")))
    emphasis = bangs * EXCLAMATION + (
        F.when(asks <= 1, 0.0).when(asks <= MAX_QUESTIONS, asks * QUESTION).otherwise(MANY_QUESTIONS)
    )
    return F.bround(compound(total, emphasis), places)


def compound(total: Column, emphasis: Column) -> Column:
    """Add the emphasis away from zero and squash to [-1, 1]."""
    stressed = bind(total, lambda v: v + F.signum(v) * emphasis)
    return bind(stressed, lambda s: s / F.sqrt(s * s + NORMALIZER))


def token_table(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, pos, token, prev1, prev2, prev3) relation of the words of each text."""
    return df.select(id_col, F.inline(tokens_in_context(F.col(text))))


def token_valences(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens with the valence of a lexicon *table*, 0 for unknown words.

    The table is joined by word on the smaller of two plans: Spark broadcasts
    it when its measured size allows and shuffles otherwise.
    """
    entries = lexicon.select(F.col("token").alias("entry"), "valence")
    joined = tokens.join(entries, F.lower("token") == F.col("entry"), "left").drop("entry")
    return joined.withColumn("valence", F.coalesce("valence", F.lit(0.0)))


def score_by_table(
    df: DataFrame, id_col: str, text: str, lexicon: DataFrame, out: str = "vader_score",
    boosters: Mapping[str, float] = defaults.BOOSTERS, negations: Sequence[str] = defaults.NEGATIONS, places: int = 4,
) -> DataFrame:
    """``df`` with ``lexicon_score`` by a lexicon table (token, valence) of any size; ``id_col`` tells the rows apart.

    The words of each text are looked up by a join, and come back as one map per text; the text itself is not shuffled with them.
    """
    found = word_values(df, id_col, F.transform(bare_words(F.col(text)), F.lower), lexicon.withColumnRenamed("token", "word").withColumnRenamed("valence", "value"))
    rows = df.join(found.withColumnRenamed("values", "_values"), id_col, "left")
    entries = F.coalesce("_values", F.create_map().cast("map<string,double>"))
    return rows.withColumn(out, lexicon_score(F.col(text), entries, boosters, negations, places)).drop("_values")
