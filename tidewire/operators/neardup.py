"""Near-duplicate texts: band collisions of MinHash signatures, greedy keep-first.

Two texts collide when they share a band key. Going through the texts in
order, one is dropped if it collides with a text already kept. Pairs are never
listed: the work stays on (text, band key) rows, whose number is fixed per
text however large a group of copies is.
"""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidewire.functions.minhash import BANDS, band_keys, minhash_signature
from tidewire.operators.components import components
from tidewire.operators.hotkeys import join_per_key
from tidewire.session import cut_lineage, scratch_path

FREE_ROUNDS = 3  # rounds before what is left is cut into its connected parts
PART_TEXTS = 50_000  # texts of a part that one task settles


def text_bands(df: DataFrame, seq: str, text: str) -> DataFrame:
    """(seq, bands): the band keys of each text, in one pass without a shuffle."""
    return df.select(F.col(seq).alias("seq"), band_keys(minhash_signature(F.col(text))).alias("bands"))


def explode_bands(bands: DataFrame) -> DataFrame:
    """(seq, band): one row per text and band key."""
    return bands.select("seq", F.explode("bands").alias("band"))


def band_firsts(rows: DataFrame) -> DataFrame:
    """(band, first, n): first text and number of texts per band key."""
    return rows.groupBy("band").agg(F.min("seq").alias("first"), F.count("*").alias("n"))


def collision_stars(rows: DataFrame) -> DataFrame:
    """(seq, first): each text with the first text of every band key they share.

    These links connect the same texts as all colliding pairs would, but there
    are at most as many of them as band rows.
    """
    firsts = band_firsts(rows).filter("n > 1")
    linked = join_per_key(rows, firsts, "band", "n").filter("seq <> first")
    return linked.select("seq", "first").distinct()


def greedy_keep_first(bands: DataFrame, per_text: int = BANDS) -> DataFrame:
    """(seq): the texts kept by the greedy rule.

    Texts with the same band keys share their fate except that only the first
    can be kept, so they are folded into it first. Then, round by round: a text
    that comes first under all of its band keys has no earlier rival left and
    is kept; all other texts under these keys are dropped. This repeats until
    no text is undecided and equals going through them one at a time.

    A chain of versions takes a round for every two links. What a few rounds
    leave undecided is therefore cut into its connected parts, and each part of
    bounded size is settled in order in one task; only larger parts go on by rounds.
    """
    distinct = bands.groupBy("bands").agg(F.min("seq").alias("seq"))
    open_rows = cut_lineage(explode_bands(distinct))
    spark, folder = bands.sparkSession, scratch_path(bands.sparkSession, "kept")
    for turn in count():
        firsts = band_firsts(open_rows)
        winners = firsts.groupBy(F.col("first").alias("seq")).count().filter(F.col("count") == per_text).select("seq")
        winners.write.parquet(f"{folder}/turn={2 * turn}")
        winners = spark.read.parquet(f"{folder}/turn={2 * turn}")
        closed = firsts.join(winners, F.col("first") == F.col("seq"), "left_semi").select("band", "n")
        decided = join_per_key(open_rows, closed, "band", "n").select("seq").distinct()
        open_rows = cut_lineage(open_rows.join(decided, "seq", "left_anti"))
        if turn + 1 == FREE_ROUNDS and not open_rows.isEmpty():
            parts = cut_lineage(open_parts(open_rows))
            settle(parts.filter(F.col("texts") <= PART_TEXTS)).write.parquet(f"{folder}/turn={2 * turn + 1}")
            large = parts.filter(F.col("texts") > PART_TEXTS)
            open_rows = cut_lineage(explode_bands(large))
        if open_rows.isEmpty():
            return spark.read.parquet(folder).select("seq")


def open_parts(rows: DataFrame) -> DataFrame:
    """(part, texts, seq, bands): undecided texts with the connected part they are in, and how many it has."""
    links = collision_stars(rows).select(F.col("seq").alias("u"), F.col("first").alias("v"))
    texts = rows.groupBy("seq").agg(F.collect_list("band").alias("bands"))
    named = texts.join(components(links).withColumnRenamed("node", "seq"), "seq", "left")
    named = named.select(F.coalesce("component", "seq").alias("part"), "seq", "bands")
    return named.join(named.groupBy("part").agg(F.count("*").alias("texts")), "part")


def settle(parts: DataFrame) -> DataFrame:
    """(seq): the texts of (part, seq, bands) kept by going through each part in order; a task holds one part's keys."""
    seq = to_arrow_schema(parts.select("seq").schema)

    def run(batches):
        at, taken = None, set()
        for batch in batches:
            kept = []
            for part, text, bands in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    at, taken = part, set()
                if taken.isdisjoint(bands):
                    taken.update(bands)
                    kept.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(kept, seq.field(0).type)], schema=seq)

    ordered = parts.select("part", "seq", "bands").repartition("part").sortWithinPartitions("part", "seq")
    return ordered.mapInArrow(run, parts.select("seq").schema)


def kept_partners(bands: DataFrame, kept: DataFrame) -> DataFrame:
    """(seq, kept_seq): each dropped text with the first kept text it collides with.

    No two kept texts share a band key, so a band key has at most one owner.
    """
    rows = explode_bands(bands)
    sizes = band_firsts(rows).filter("n > 1").select("band", "n")
    owners = rows.join(kept, "seq", "left_semi").withColumnRenamed("seq", "owner")
    owned = join_per_key(rows, sizes.join(owners, "band"), "band", "n")
    return owned.filter("owner < seq").groupBy("seq").agg(F.min("owner").alias("kept_seq"))


def pair_jaccard(pairs: DataFrame, texts: DataFrame, left: str, right: str) -> DataFrame:
    """Exact Jaccard similarity of the word sets of listed pairs.

    ``texts`` is (seq, words). ``left`` must be unique; ``right`` may repeat
    many times, so its word set is first copied once per salt in use.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64(left), F.lit(256)))
    copies = salted.select(right, "salt").distinct()
    rights = copies.join(texts.select(F.col("seq").alias(right), F.col("words").alias("right_words")), right)
    lefts = salted.join(texts.select(F.col("seq").alias(left), F.col("words").alias("left_words")), left)
    both = lefts.join(rights, [right, "salt"])
    shared = F.size(F.array_intersect("left_words", "right_words"))
    either = F.size("left_words") + F.size("right_words") - shared
    jaccard = F.when(either == 0, 1.0).otherwise(shared / either)
    return both.select(left, right, jaccard.alias("jaccard"))
