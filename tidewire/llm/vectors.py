"""Vectors in packed blocks, and a stated query set against all blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.tasks import map_rows
from tidewire.session import cut_lineage

BLOCK_ROWS = 8192
QUERY_ROWS = 512
SLICE_BLOCKS = 8  # blocks of queries that one task puts to a block of rows
PAIR = "query_id long, vec_id long, score {}"


def usable(vectors: DataFrame, vec_id: str, embedding: str, zero: bool) -> DataFrame:
    """(vec_id, v): vectors as doubles, without null, incomplete, non-finite, and, unless ``zero``, all-zero ones.

    A vector without components is left out, and so is one without an id.
    """
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    keep = F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~bad
    return rows.filter(keep if zero else keep & F.exists(v, lambda x: x != 0))


def one_per_id(queries: DataFrame) -> DataFrame:
    """(vec_id, v): of queries that share an id, the one with the smallest vector counts."""
    return queries.groupBy("vec_id").agg(F.min("v").alias("v"))


def in_blocks(rows: DataFrame, block_rows: int, *keys: str) -> DataFrame:
    """``rows`` with ``block``: those with equal ``keys`` in blocks of about ``block_rows``, numbered from 0, by a hash of the row."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    blocks = F.ceil(F.col("_n") / block_rows).cast("int")
    return rows.join(sizes, list(keys)).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), blocks).cast("int")).drop("_n")


def pack(rows: DataFrame, block_rows: int) -> DataFrame:
    """(shard, width, block, ids, matrix, limits): rows of (shard, width, vec_id, v, limit) in blocks, as bytes."""
    keys = ["shard", "width", "block"]
    cut = in_blocks(rows, block_rows, "shard", "width").select(*keys, "vec_id", "v", "limit")
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        at, held = None, ([], [], [])

        def block():
            return [[k] for k in at] + [[np.array(x, t).tobytes()] for x, t in zip(held, ("<i8", "<f8", "<f8"), strict=True)]

        for row in (r for b in batches for r in zip(*b, strict=True)):
            if row[:3] != at:
                if at is not None:
                    yield block()
                at, held = row[:3], ([], [], [])
            for x, value in zip(held, row[3:], strict=True):
                x.append(value)
        if at is not None:
            yield block()

    dealt = cut.repartition(shuffles, *keys).sortWithinPartitions(*keys)
    return map_rows(dealt, run, "shard int, width int, block int, ids binary, matrix binary, limits binary")


def meet(blocks: DataFrame, asked: DataFrame, find: Callable, k: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score): for each block of queries the best rows in each block of their shard.

    ``find(ids, matrix)`` makes a block's index; called with (query ids, query matrix, limits, k) it returns arrays (query
    number, vec_id, score) that hold the block's best ones. A block of rows meets the queries of its shard slice by
    slice, each in a task of its own, and its index is built once in each.
    """
    asked = asked.select("shard", "width", F.floor(F.col("block") / SLICE_BLOCKS).cast("int").alias("slice"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "matrix", "limits")])
    slices = asked.select("shard", "width", "slice").distinct()
    pieces = blocks.select("shard", "width", "block").distinct()
    spread = asked.join(pieces, ["shard", "width"])
    wanted = blocks.drop("limits").join(slices, ["shard", "width"])
    keys = ["shard", "width", "block", "slice"]
    rows = spread.hint("merge").join(wanted, keys).select(*keys, "q_ids", "q_matrix", "q_limits", "ids", "matrix")

    def run(batches):
        at, index = None, None
        for *key, q_ids, q_matrix, q_limits, ids, matrix in (r for b in batches for r in zip(*b, strict=True)):
            asked = np.frombuffer(q_ids, "<i8")
            if key != at:
                own = np.frombuffer(ids, "<i8")
                at, index = key, find(own, np.frombuffer(matrix, "<f8").reshape(len(own), -1))
            number, found, score = index(asked, np.frombuffer(q_matrix, "<f8").reshape(len(asked), -1), np.frombuffer(q_limits, "<f8"), k)
            yield [asked[number], found, score]

    return map_rows(rows, run, PAIR.format(kind))


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(
    vectors: DataFrame, queries: DataFrame, find: Callable, k: int, kind: str, block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of each query over all blocks, see ``meet``.

    Every query meets every block; each meeting hands on at most ``k`` rows per query, which are then merged. Queries that
    share an id count once, see ``one_per_id``.
    """
    plain = lambda rows: rows.select(F.lit(0).alias("shard"), F.size("v").alias("width"), "vec_id", "v", F.lit(float("-inf")).alias("limit"))
    blocks, asked = cut_lineage(pack(plain(vectors), block_rows)), cut_lineage(pack(plain(one_per_id(queries)), query_rows))
    return ranked(meet(blocks, asked, find, k, kind), k)


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    sorted_query = query[order]
    start = np.searchsorted(sorted_query, sorted_query)
    return order[np.arange(len(order)) - start < k]
