"""Collected articles in shards by URL, with a record of the slots that are done."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.session import cut_lineage

SHARDS = 256
BATCH, SHARD = "batch", "shard"


class UrlStore:
    """Articles, each URL once, below ``path``: ``articles/batch=../shard=..`` and ``progress/batch=..``.

    The shard is a hash of the URL, so a batch looks for its URLs in the shards
    it has URLs of, and nowhere else. A batch counts from when its slots are recorded; one that was cut off
    before is not seen by any reader, and written over when it is run again.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards

    def shard_of(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.shards)).cast("int")

    def _stored(self, schema: T.StructType) -> DataFrame:
        keys = [T.StructField(BATCH, T.LongType()), T.StructField(SHARD, T.IntegerType())]
        full = T.StructType([f for f in schema.fields if f.name not in (BATCH, SHARD)] + keys)
        try:
            return self.spark.read.schema(full).parquet(f"{self.path}/articles")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], full)

    def finished(self) -> DataFrame:
        """(slot, batch): the slots that are done."""
        schema = "slot string, batch long"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/progress")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def next_batch(self) -> int:
        """The number of the batch to write: that after the last one recorded."""
        last = self.finished().agg(F.max(BATCH)).first()[0]
        return 0 if last is None else last + 1

    def known(self, shards: list[int], before: int, schema: T.StructType) -> DataFrame:
        """(url) of batches ``before`` this one in some shards; of other shards no file is opened."""
        return self._stored(schema).filter(F.col(SHARD).isin(shards) & (F.col(BATCH) < before)).select("url")

    def append(self, articles: DataFrame, batch: int | None = None, slots: DataFrame | None = None) -> None:
        """Add the articles, each URL once, whose URL no earlier batch has; then record ``slots`` as done.

        Written again under its number, a batch replaces itself. A stream numbers its batches itself, and keeps its own
        record of what is done. Null URLs are not stored.
        """
        batch = self.next_batch() if batch is None else batch
        rows = articles.filter(F.col("url").isNotNull()).withColumn(SHARD, self.shard_of(F.col("url")))
        rows = cut_lineage(rows)
        used = sorted(r[0] for r in rows.select(SHARD).distinct().collect())  # at most as many as there are shards
        fresh = rows.join(self.known(used, batch, rows.schema), "url", "left_anti") if batch and used else rows
        fresh.repartition(SHARD).write.mode("overwrite").partitionBy(SHARD).parquet(f"{self.path}/articles/{BATCH}={batch}")
        if slots is not None:
            slots.select(F.col("slot").cast("string").alias("slot")).write.mode("overwrite").parquet(f"{self.path}/progress/{BATCH}={batch}")

    def read(self, schema: T.StructType | str, recorded: bool = True) -> DataFrame:
        """The stored articles, with ``batch``; of a stream, which records no slots here, with ``recorded`` false."""
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        rows = self._stored(schema)
        if recorded:
            rows = rows.filter(F.col(BATCH) < self.next_batch())
        return rows.drop(SHARD)
