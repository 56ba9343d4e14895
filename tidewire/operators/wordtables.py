"""Tables of words of any size, looked up for the words of texts, and singular forms checked by a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of plural nouns and what stands in their place.
PLURALS = (("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))


def word_values(df: DataFrame, id_col: str, tokens: Column, table: DataFrame) -> DataFrame:
    """(id, values): for each row a map from those of its words that ``table`` (word, value) has to their value.

    A row sends each different word once. Spark broadcasts the table if it is
    measured to be short, and shuffles by word otherwise, where a word that most texts have is split.
    """
    each = df.select(id_col, F.explode(F.array_distinct(tokens)).alias("word"))
    found = each.join(table.select("word", "value").dropDuplicates(["word"]), "word")
    return found.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("word", "value"))).alias("values"))


def singular_forms(words: DataFrame, nouns: DataFrame) -> DataFrame:
    """(word, value): the singular form of each different word, for those that change.

    Of the word itself and what the endings make of it, the shortest that is in the dictionary ``nouns`` (noun) is taken, of equally short
    ones the first in order; a word without such a form stays whole.
    """
    word = F.col("word")
    stem = lambda end: word.substr(F.lit(1), F.length(word) - F.lit(len(end)))
    forms = [F.when(word.endswith(end), F.concat(stem(end), F.lit(put))) for end, put in PLURALS]
    each = words.select("word").distinct().select("word", F.explode(F.array_compact(F.array(word, *forms))).alias("form"))
    known = each.join(nouns.select(F.col("noun").alias("form")).distinct(), "form")
    best = known.groupBy("word").agg(F.min(F.struct(F.length("form").alias("n"), "form")).alias("best"))
    return best.select("word", F.col("best.form").alias("value")).filter("word <> value")


def corpus_nouns(words: DataFrame, least: int = 5) -> DataFrame:
    """(noun): words that occur at least ``least`` times, as a dictionary where there is no other."""
    return words.groupBy("word").count().filter(F.col("count") >= least).select(F.col("word").alias("noun"))


def lemmatize_by_table(df: DataFrame, id_col: str, tokens: str, nouns: DataFrame) -> DataFrame:
    """``df`` with the array ``tokens`` in singular forms that the dictionary has."""
    forms = singular_forms(df.select(F.explode(tokens).alias("word")), nouns)
    rows = df.join(word_values(df, id_col, F.col(tokens), forms), id_col, "left")
    replaced = F.transform(tokens, lambda w: F.coalesce(F.try_element_at(F.col("values"), w), w))
    return rows.withColumn(tokens, F.when(F.col("values").isNull(), F.col(tokens)).otherwise(replaced)).drop("values")
