"""Merging feeds into the stored articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.operators.dedup import keep_first, not_stored


def cap_per_feed(df: DataFrame, caps: dict[str, int], feed: str = "feed", seq: str = "seq", answer: str | None = None) -> DataFrame:
    """At most ``caps[feed]`` first rows of each feed, or of each answer of it if ``answer`` names a column."""
    rank = F.row_number().over(W.partitionBy(feed, *([answer] if answer else [])).orderBy(seq))
    cap = F.lit(0)
    for name, most in caps.items():
        cap = F.when(F.col(feed) == name, most).otherwise(cap)
    ranked = df.withColumn("_rank", rank).filter(F.col("_rank") <= max(caps.values()))
    return ranked.filter(F.col("_rank") <= cap).drop("_rank")


def new_from_feeds(stored: DataFrame, *feeds: DataFrame, few_new: bool = False) -> DataFrame:
    """Rows of the feeds not stored yet, each URL once, earlier feeds first.

    A NULL URL is never stored as known, so one NULL row gets through.
    """
    ranked = [f.withColumn("feed_no", F.lit(i)) for i, f in enumerate(feeds)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return not_stored(keep_first(rows, "url", "feed_no", "seq"), stored, few_new=few_new)


def merge_feeds(stored: DataFrame, *feeds: DataFrame, few_new: bool = False) -> DataFrame:
    """Stored rows followed by the new ones."""
    return stored.unionByName(new_from_feeds(stored, *feeds, few_new=few_new).drop("feed_no"), allowMissingColumns=True)
