"""Stopping at a target count, at the granularity of whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.operators.hotkeys import is_short

FEW = 10_000
PARTS = 100


def files_before_target(counts: DataFrame, target: int, order: str = "file_no") -> DataFrame:
    """Files that are still read: those before which fewer than ``target`` rows were found.

    ``counts`` has one row (``order``, n) per listed file, at most as many as
    the slot list, so the running total is over a short table, not over articles.
    """
    so_far = F.sum("n").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return (
        counts.withColumn("collected_before", F.coalesce(so_far, F.lit(0)))
        .filter(F.col("collected_before") < target)
    )


def quota_by_file(rows: DataFrame, files: DataFrame, target: int, order: str = "file_no") -> tuple[DataFrame, DataFrame]:
    """Split ``rows`` (each URL once, tagged with its file) at the quota.

    Returns the accepted rows and the table of files tried. ``files`` lists
    every slot, also those without rows: they count as tried.
    """
    found = rows.groupBy(order).agg(F.count("*").alias("n"))
    counts = files.join(found, order, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tried = files_before_target(counts, target, order)
    numbers = tried.select(order)
    accepted = rows.join(F.broadcast(numbers) if is_short(files) else numbers, order, "left_semi")
    return accepted, tried


def nth_smallest(df: DataFrame, order: str, n: int) -> int | None:
    """The ``n``-th smallest number in ``order``; None if there are fewer.

    Each pass counts the numbers between some hundred quantiles of the range that is left, and goes on with the part that the
    n-th lies in. At most ``FEW`` numbers are ever brought together.
    """
    rows = df.select(order).filter(F.col(order).isNotNull())
    if n < 1 or (count := rows.count()) < n:
        return None
    while count > FEW:
        cuts = rows.agg(F.percentile_approx(order, [i / PARTS for i in range(1, PARTS)], 10 * PARTS)).first()[0]
        cuts = sorted(set(cuts))
        below = rows.agg(*[F.count_if(F.col(order) <= c) for c in cuts]).first()
        at = next((i for i, b in enumerate(below) if b >= n), len(cuts))
        if at < len(cuts):
            rows = rows.filter(F.col(order) <= cuts[at])
        if at:
            rows, n = rows.filter(F.col(order) > cuts[at - 1]), n - below[at - 1]
        left = (below[at] if at < len(cuts) else count) - (below[at - 1] if at else 0)
        if left == count or (at < len(cuts) and rows.agg(F.min(order)).first()[0] == cuts[at]):
            return cuts[min(at, len(cuts) - 1)]  # all that is left are equal
        count = left
    return sorted(r[0] for r in rows.collect())[n - 1]


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest numbers in ``order``, or all if there are fewer; rows without one come last and are left out.

    A filter, not a sort: no task gets more rows than it read. Numbers should differ; with equal ones at the end, all of them are taken.
    """
    if n < 1:
        return df.limit(0)
    last = nth_smallest(df, order, n)
    return df if last is None else df.filter(F.col(order) <= last)
