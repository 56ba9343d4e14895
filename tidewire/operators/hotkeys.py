"""Joins whose small side is checked, and joins where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 10_000
HOT_ROWS = 20_000
MAX_BROADCAST_ROWS = 100_000


def is_short(df: DataFrame) -> bool:
    """Whether a narrow list has few enough rows to send to every executor; counts no further than that."""
    return df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS


def short_side(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is short; otherwise Spark joins it by shuffle."""
    return F.broadcast(df) if is_short(df) else df


def join_per_key(rows: DataFrame, lookup: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` to ``lookup``, which has one row per ``key``.

    ``lookup[size]`` tells how many rows a key has. The largest keys, at most
    ``MAX_HOT_KEYS`` of them, are joined by broadcast, so their rows are never
    gathered in one task; each key left for the shuffle join then holds fewer
    rows than one in ``MAX_HOT_KEYS``, or fewer than ``HOT_ROWS``. ``rows`` is
    read twice and should be cheap to read again.
    """
    hot = lookup.filter(F.col(size) > HOT_ROWS).orderBy(F.desc(size), key).limit(MAX_HOT_KEYS)
    by_broadcast = rows.join(F.broadcast(hot), key)
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return by_broadcast.unionByName(cold_rows.join(lookup, key))
