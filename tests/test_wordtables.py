"""Lexicon tables of any size, and singular forms checked by a dictionary."""

import pytest
from pyspark.sql import functions as F

from tidewire.operators import lexicon, wordtables

NOUNS = """axis ax cache cookie sander bank rate tax box city glass bus boss match dish fox quiz man woman child news series
leaf party vote poll market stock bond share price trader country policy crisis analysis church wish class gas lens virus
horse house rose size prize exchange day key toy monkey army story study baby lady event people process address business"""
# Word and expected form: what the dictionary has, shortest first, and whole where it has nothing.
FORMS = {
    "hamas": "hamas", "axes": "ax", "caches": "cache", "cookies": "cookie", "sanders": "sander", "banks": "bank", "rates": "rate", "taxes": "tax",
    "boxes": "box", "cities": "city", "glasses": "glass", "buses": "bus", "bosses": "boss", "matches": "match", "dishes": "dish", "foxes": "fox",
    "men": "man", "women": "woman", "children": "children", "news": "news", "series": "series", "leaves": "leaves", "parties": "party", "votes": "vote",
    "polls": "poll", "markets": "market", "stocks": "stock", "bonds": "bond", "shares": "share", "prices": "price", "traders": "trader",
    "countries": "country", "policies": "policy", "crisis": "crisis", "crises": "crises", "analysis": "analysis", "churches": "church", "wishes": "wish",
    "classes": "class", "gases": "gas", "lenses": "lens", "viruses": "virus", "horses": "horse", "houses": "house", "roses": "rose", "sizes": "size",
    "prizes": "prize", "exchanges": "exchange", "days": "day", "keys": "key", "toys": "toy", "monkeys": "monkey", "armies": "army", "stories": "story",
    "studies": "study", "babies": "baby", "ladies": "lady", "events": "event", "people": "people", "processes": "process", "addresses": "address",
    "businesses": "business", "s": "s", "ies": "ies", "us": "us", "": "", "paris": "paris", "texas": "texas", "brussels": "brussels", "quizzes": "quizzes",
}


def test_forms_that_the_dictionary_has(spark):
    words = spark.createDataFrame([(w,) for w in FORMS], "word string")
    nouns = spark.createDataFrame([(n,) for n in NOUNS.split()], "noun string")
    found = {r.word: r.value for r in wordtables.singular_forms(words, nouns).collect()}
    assert {w: found.get(w, w) for w in FORMS} == FORMS
    rows = spark.createDataFrame([(1, ["banks", "hamas", "banks"]), (2, []), (3, None)], "id long, tokens array<string>")
    got = {r.id: r.tokens for r in wordtables.lemmatize_by_table(rows, "id", "tokens", nouns).collect()}
    assert got == {1: ["bank", "hamas", "bank"], 2: [], 3: None}


def test_table_scores_as_the_constant_does(spark):
    entries = {"good": 1.9, "bad": -2.5, "great": 3.1, "kind": 2.4}
    texts = ["not good at all!", "GREAT and kind of bad", "very very good but bad", "", None, "nothing here", "isn't great??"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame(list(entries.items()), "token string, valence double")
    found = lexicon.score_by_table(df, "id", "text", table, "s").withColumn("constant", lexicon.lexicon_score(F.col("text"), entries))
    rows = found.collect()
    assert len(rows) == len(texts) and all(r.s == r.constant for r in rows) and sum(r.s != 0 for r in rows) == 4


def test_lexicon_beyond_what_travels_as_a_constant(spark):
    table = spark.range(250_000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("token"), F.lit(2.0).alias("valence"))
    df = spark.createDataFrame([(1, "not word249999 here"), (2, "word7"), (3, "none")], "id long, text string")
    got = {r.id: r.vader_score for r in lexicon.score_by_table(df, "id", "text", table).collect()}
    assert got[1] < 0 < got[2] and got[3] == 0
    with pytest.raises(ValueError):
        lexicon.lexicon_score(F.col("text"), {f"w{i}": 1.0 for i in range(200_001)})
