"""Bounded samples of labelled rows, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.session import cut_lineage


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: the checksum of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int, max_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, label, fold): at most ``rows`` labelled rows outside the held-out part.

    They are the first ones in the order of a hash of the id, so the same rows
    are taken each time. Labels that are null or contradict each other are left
    out. With ``max_bytes`` rows are taken in that order until their texts, whatever the
    length of each, have so many bytes. Of rows that repeat an id, the
    smallest text is taken, so that the bound holds. ``fold`` is 0 to 3.
    """
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    own = own.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    order = F.xxhash64(F.lit(7), "doc_id")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = own.filter("label = most").withColumn("order", order).orderBy("order").limit(rows)
    some = texts.join(F.broadcast(chosen.drop("most")), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    if max_bytes is not None:
        some = cut_lineage(some.withColumn("order", order))
        sizes, taken, last = some.select("order", F.octet_length("text")).collect(), 0, None
        for place, size in sorted(sizes):
            if taken >= max_bytes:
                break
            taken, last = taken + size, place
        some = some.filter(F.col("order") <= F.lit(last).cast("long"))
    return some.select("doc_id", "text", "label", F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(4)).cast("int").alias("fold"))
