"""Keep-first de-duplication and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """One row per ``key``: the first by ``order``, which must be a total order.

    The rank filter lets Spark keep only each task's first row per key before
    the shuffle, so a key that holds a third of all rows still sends at most
    one row per task.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def not_stored(new: DataFrame, stored: DataFrame, key: str = "url", few_new: bool = False) -> DataFrame:
    """Rows of ``new`` whose key is not in ``stored``; a NULL key counts as new.

    Pass ``few_new`` when the number of new rows is known to be small (see
    ``is_short``): their keys are then sent to the stored rows, of which only
    the matching ones go on, and the store itself is never shuffled. New rows
    with a repeated key should be de-duplicated first (see ``keep_first``).
    """
    known = stored.select(key).filter(F.col(key).isNotNull())
    if few_new:
        known = known.join(F.broadcast(new.select(key).distinct()), key, "left_semi")
    return new.join(known.distinct(), key, "left_anti")
