"""Event studies: article scores in the days before and after each event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.dates import parse_timestamp
from tidewire.functions.stats import student, t_two_sided, welch

DAY_MICROS = 86_400_000_000
EVENT_KEYS = ["event_name", "event_date"]
DAY_SIDES = ("pre", "post")
INSTANT_SIDES = ("before", "after")


def _present(c):
    """NaN scores count as missing."""
    return F.when(~F.isnan(c), c)


def event_days(events: DataFrame, days: int = 7) -> DataFrame:
    """(event_name, event_date, side, day): calendar days around each event, without its own day."""
    day = F.to_date("event_date")
    ahead = F.sequence(F.date_sub(day, days), F.date_sub(day, 1))
    behind = F.sequence(F.date_add(day, 1), F.date_add(day, days))
    sides = F.array(
        F.struct(F.lit("pre").alias("side"), ahead.alias("dates")),
        F.struct(F.lit("post").alias("side"), behind.alias("dates")),
    )
    return events.select("event_name", "event_date", F.inline(sides)).select(
        "event_name", "event_date", "side", F.explode("dates").alias("day")
    ).filter(F.col("day") >= F.lit("0001-01-01").cast("date"))  # tells Spark that the days are few, so others are not read


def daily_moments(articles: DataFrame, *keys: str) -> DataFrame:
    """n, mean and m2 per day: all that a mean or variance over several days needs."""
    score = _present(F.col("sentiment_score"))
    per_day = articles.groupBy(*keys).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.var_pop(score).alias("var")
    )
    return per_day.filter("n > 0").select(*keys, "n", "mean", (F.col("n") * F.col("var")).alias("m2"))


def _merge_moments(parts: DataFrame, sides: tuple[str, str]) -> DataFrame:
    """Sample counts, means and variances of both sides from per-day moments.

    The variance adds the spread inside the days to the spread between their
    means, taken around the common mean, so no large squares cancel. A side has
    at most one part per day of its window.
    """
    total = parts.groupBy(*EVENT_KEYS, "side").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.collect_list(F.struct("n", "mean", "m2")).alias("parts"),
    )
    around = F.aggregate(
        "parts", F.lit(0.0),
        lambda s, p: s + p["m2"] + p["n"] * F.pow(p["mean"] - F.col("mean"), 2),
    )
    merged = total.withColumn("var", F.when(F.col("n") > 1, around / (F.col("n") - 1)))
    picks = [
        F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
        for side in sides for c in ("n", "mean", "var")
    ]
    return merged.groupBy(*EVENT_KEYS).agg(*picks)


def _per_event(events: DataFrame, stats: DataFrame, sides: tuple[str, str]) -> DataFrame:
    """Every event with its statistics, and counts of 0 where it has no articles."""
    joined = events.select(*EVENT_KEYS).join(stats, EVENT_KEYS, "left")
    return joined.na.fill(0, [f"{side}_n" for side in sides])


def _moments_of(sides: tuple[str, str]) -> list:
    return [F.col(f"{side}_{c}") for side in sides for c in ("n", "mean", "var")]


def window_stats_days(articles: DataFrame, events: DataFrame, days: int = 7) -> DataFrame:
    """One row per event: n, mean and variance of the scores before and after.

    ``articles`` needs ``published_date`` and ``sentiment_score``. They are
    reduced to one row per day before they meet the events, so the join is
    between two short tables however many articles or events there are. Of a table in one folder
    for each day (``write_dated``) only the days around events are read.
    """
    wanted = event_days(events.select(*EVENT_KEYS).distinct(), days)
    dated = articles.withColumnRenamed("published_date", "day").join(wanted.select("day"), "day", "left_semi")
    around = wanted.join(daily_moments(dated, "day"), "day")
    return _per_event(events, _merge_moments(around, DAY_SIDES), DAY_SIDES)


def event_study_days(articles: DataFrame, events: DataFrame, days: int = 7) -> DataFrame:
    """Welch test on calendar days, event day excluded, more than two scores on both sides."""
    stats = window_stats_days(articles, events, days)
    t, df = welch(*_moments_of(DAY_SIDES))
    enough = (F.col("pre_n") > 2) & (F.col("post_n") > 2)
    return stats.withColumns({"t": F.when(enough, t), "df": df}).select(
        *EVENT_KEYS,
        F.col("pre_n").alias("pre_7d_volume"),
        F.col("post_n").alias("post_7d_volume"),
        F.when(enough, F.col("post_mean") - F.col("pre_mean")).alias("sentiment_shift_mean"),
        F.col("t").alias("t_stat"),
        t_two_sided(F.col("t"), F.col("df")).alias("p_value"),
    )


def named_events(events: DataFrame) -> DataFrame:
    """Events under one pair of column names, whichever of the two spellings they came with."""
    have = events.columns
    name = F.col("event_name") if "event_name" in have else F.col("name") if "name" in have else F.lit("")
    date = F.col("event_date") if "event_date" in have else F.col("date")
    return events.select(name.alias("event_name"), date.cast("string").alias("event_date"))


def window_stats_instants(articles: DataFrame, events: DataFrame, days: int = 7) -> DataFrame:
    """One row per event over the half-open windows [p - days, p) and [p, p + days).

    Counted from the event's time of day, both windows are whole days. Each
    such shifted day lies in at most two calendar days. Articles meet only the
    shifted days that some window needs, by their calendar day, and are reduced
    to one row for each; the last join is again between two short tables.
    """
    pivot = F.unix_micros(parse_timestamp(F.col("event_date")))
    pivots = events.select(*EVENT_KEYS).distinct().withColumns({
        "clock": F.pmod(pivot, F.lit(DAY_MICROS)),
        "day0": F.floor(pivot / DAY_MICROS),
    }).filter("day0 IS NOT NULL")

    instant = F.col("published_at")
    if dict(articles.dtypes)["published_at"] == "string":
        instant = parse_timestamp(instant)
    micros = F.unix_micros(instant.cast("timestamp"))
    dated = articles.select("sentiment_score", micros.alias("micros"), F.floor(micros / DAY_MICROS).alias("calendar_day"))

    offset = F.explode(F.sequence(F.lit(-days), F.lit(days - 1)))
    around = pivots.withColumn("offset", offset).select(
        *EVENT_KEYS, "clock", (F.col("day0") + F.col("offset")).alias("day"),
        F.when(F.col("offset") < 0, "before").otherwise("after").alias("side"),
    )
    calendar = F.when(F.col("clock") == 0, F.array("day")).otherwise(F.array("day", F.col("day") + 1))
    wanted = around.select("clock", "day").distinct().withColumn("calendar_day", F.explode(calendar))
    inside = F.floor((F.col("micros") - F.col("clock")) / DAY_MICROS) == F.col("day")
    moments = daily_moments(dated.join(wanted, "calendar_day").filter(inside), "clock", "day")
    return _per_event(events, _merge_moments(around.join(moments, ["clock", "day"]), INSTANT_SIDES), INSTANT_SIDES)


def event_study_instants(articles: DataFrame, events: DataFrame, days: int = 7) -> DataFrame:
    """Pooled-variance test on instants, event day in ``after``, two scores on both sides at least.

    Results are rounded half to even. A statistic or probability of exactly 0
    is reported as missing, and then never counts as significant.
    """
    events = named_events(events)
    stats = window_stats_instants(articles, events, days)
    t, df = student(*_moments_of(INSTANT_SIDES))
    enough = (F.col("before_n") >= 2) & (F.col("after_n") >= 2)
    tested = stats.withColumns({"t": F.when(enough, t), "df": df})
    tested = tested.withColumn("p", t_two_sided(F.col("t"), F.col("df")))
    return tested.select(
        *EVENT_KEYS,
        F.bround("before_mean", 4).alias("before_mean"),
        F.bround("after_mean", 4).alias("after_mean"),
        F.col("before_n").alias("before_count"),
        F.col("after_n").alias("after_count"),
        F.when(F.col("t") != 0, F.bround("t", 4)).alias("t_statistic"),
        F.when(F.col("p") != 0, F.bround("p", 4)).alias("p_value"),
        F.coalesce((F.col("p") < 0.05) & (F.col("p") != 0), F.lit(False)).alias("significant"),
    )
