"""Names of the feed files to read: one per time slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.dates import floor_quarter, slot_name


def recent_slots(anchors: DataFrame, now: Column, max_files: int = 300) -> DataFrame:
    """(file_no, slot): the quarter hour of ``now`` and those before it, newest first.

    ``anchors`` is a one-row frame; ``now`` is a timestamp expression over it.
    """
    last = floor_quarter(now)
    first = last - F.make_dt_interval(mins=F.lit(15 * (max_files - 1)))
    walk = F.sequence(last, first, F.expr("INTERVAL -15 MINUTES"))
    return anchors.select(F.posexplode(walk).alias("file_no", "at")).select(
        "file_no", slot_name(F.col("at")).alias("slot")
    )


def window_slots(windows: DataFrame, every_hours: int = 6) -> DataFrame:
    """(name, file_no, slot): every sixth hour of each window, both ends included; ``window_no`` is kept if there."""
    at = lambda c: F.to_timestamp(c, "yyyyMMddHHmmss")
    walk = F.sequence(at("start"), at("end"), F.expr(f"INTERVAL {every_hours} HOURS"))
    keep = [c for c in ("name", "window_no") if c in windows.columns]
    return windows.select(*keep, F.posexplode(walk).alias("file_no", "at")).select(
        *keep, "file_no", slot_name(F.col("at")).alias("slot")
    )
