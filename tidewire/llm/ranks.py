"""Running sums inside groups of any size, a large group being summed slice by slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256
SLICE_ROWS = 100_000


def slices_for(rows: int) -> int:
    """Slices per group, so that a group with all rows still has slices of bounded size."""
    return max(SLICES, -(-rows // SLICE_ROWS))


def running_sum(rows: DataFrame, group: str, order: Column, weight: Column, slices: int, facts: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``before``: the sum of ``weight`` over the rows of the group that come earlier.

    ``order`` is a 64-bit hash, and each group is cut into ``slices`` equal
    ranges of it. Slices are summed first; each row then needs only the rows
    of its own slice and the total of the slices before. ``group`` must not be
    null. ``facts``, one row per group, is attached on the way. Rows with an
    equal hash come in any order.
    """
    step = (1 << 64) // slices + 1
    place = F.floor((order.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")) / F.lit(step).cast("decimal(20,0)"))
    cut = rows.withColumns({"_order": order, "_weight": weight}).withColumn("_slice", place.cast("int"))
    totals = cut.groupBy(group, "_slice").agg(F.sum("_weight").alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(group, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    if facts is not None:
        base = base.join(facts, group)
    inside = Window.partitionBy(group, "_slice").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.join(base, [group, "_slice"]).withColumn("before", F.col("_base") + F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    return summed.drop("_order", "_weight", "_slice", "_base")
