"""The exact similarity join against a comparison of all pairs, and its work on copies and common words."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewire.operators import simjoin

SCHEMA = "seq long, words array<string>, rep string, n string, digest int"


def table(spark, rows):
    return spark.createDataFrame([(i, w, "x", "y", 1) for i, w in rows], SCHEMA).repartition(4)


def plain(rows, threshold):
    sets, links, top = [set(w or []) for _, w in rows], [0] * len(rows), list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (a | b and len(a & b) / len(a | b) >= threshold):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    least = {}
    for i, (s, _) in enumerate(rows):
        if s is not None:
            least[root(i)] = min(s, least.get(root(i), s))
    return Counter((s, links[i], least.get(root(i))) for i, (s, _) in enumerate(rows))


def near_copies(seed, size):
    """Texts, most of them edited copies of others, so that similarities lie on both sides of the limit."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of"] * 40
    rows = []
    for i in range(size):
        if rows and rng.random() < 0.7:
            words = list(rng.choice(rows)[1])
            for _ in range(rng.randrange(0, 1 + len(words) // 7)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 5, 9, 20, 60]))]
        rows.append((i, words))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("threshold, part_rows", [(0.8, 512), (0.8, 5), (0.5, 40), (1.0, 3)])
def test_equals_all_pairs(spark, monkeypatch, threshold, part_rows):
    monkeypatch.setattr(simjoin, "PART_ROWS", part_rows)
    monkeypatch.setattr(simjoin, "COLUMNS", 16)
    rows = near_copies(part_rows, 260) + [(900, None), (901, []), (902, ["a", "a"]), (903, ["a"]), (None, ["a"]), (None, ["only", "here"]), (5, ["a"])]
    found = simjoin.similar_sets(table(spark, rows), "seq", "words", threshold)
    assert found.columns == ["seq", "n_links", "class_id"]
    expected = plain(rows, threshold)
    assert Counter(map(tuple, found.collect())) == expected
    assert sum(n for (_, links, _), n in expected.items() if links) > 50


def test_no_rows(spark):
    assert simjoin.similar_sets(table(spark, []), "seq", "words").count() == 0


def test_copies_are_compared_once(spark):
    """Ten thousand copies are one set: nothing but one row for each is ever made of them."""
    words = [f"w{i}" for i in range(40)]
    copies = spark.range(10_000).select(F.col("id").alias("seq"), F.array(*map(F.lit, words)).alias("words"))
    near = spark.range(1).select(F.lit(20_000).cast("long").alias("seq"), F.array(*map(F.lit, words[:39])).alias("words"))
    both = copies.unionByName(near)
    sets = simjoin.word_sets(both, "seq", "words")
    assert sets.select("digest").distinct().count() == 2
    counts = simjoin.similar_sets(both, "seq", "words").groupBy("n_links", "class_id").count().collect()
    assert sorted(map(tuple, counts)) == [(10_000, 0, 10_001)]


def test_only_prefixes_are_filed():
    for size in range(1, 400):
        n = simjoin.prefix_length(size, 0.8)
        # Two sets of this size at 0.8 lack at most this many of each other's words.
        assert n == size - -(-8 * size // 10) + 1 and 1 <= n <= size


def test_rare_words_come_first(spark):
    rows = [(i, ["the", f"w{i}"]) for i in range(50)]
    sets = simjoin.word_sets(table(spark, rows), "seq", "words").selectExpr("node AS rep", "CAST(1 AS LONG) AS n", "size", "words").cache()
    counts = simjoin.rarity(sets)
    assert counts.sum() == 100 and counts.max() == 50
    filed = simjoin.file_prefixes(simjoin.rare_first(sets, counts), 0.8)
    first = filed.filter("place = 0").groupBy("word").count()
    assert first.count() == 50  # the common word is nowhere first


def test_a_pair_is_fetched_under_few_words(spark):
    """Near copies share nearly all their first words, and are handed on under the first of these alone."""
    rows = [(i, [f"w{k}" for k in range(400) if k != 7 * i]) for i in range(20)]
    sets = simjoin.word_sets(table(spark, rows), "seq", "words").selectExpr("node AS rep", "CAST(1 AS LONG) AS n", "size", "words").cache()
    filed = simjoin.file_prefixes(simjoin.rare_first(sets, simjoin.rarity(sets)), 0.8)
    assert filed.count() == 20 * 80
    found = simjoin.candidates(filed, 0.8)
    assert found.select("rep").distinct().count() == 20 and found.count() <= 3 * 20


def test_small_pieces_of_the_sieve_lose_no_link(spark, monkeypatch):
    for name, value in {"SIEVE_ROWS": 6, "SLICE": 2, "BITS": 64}.items():
        monkeypatch.setattr(simjoin, name, value)
    rows = near_copies(3, 200)
    assert Counter(map(tuple, simjoin.similar_sets(table(spark, rows), "seq", "words").collect())) == plain(rows, 0.8)
