"""Declared schemas of the relations that enter and leave the jobs."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


GKG_LINE = T.StructType(_fields("date", "source", "url", "themes", "tone_csv"))

ARTICLE = T.StructType(
    [T.StructField("seq", T.LongType())]
    + _fields("url", "source", "headline", "published_at", "scrape_at", "body")
    + [T.StructField("gdelt_tone", T.DoubleType()), *_fields("themes")]
)

FEED_A = T.StructType([
    T.StructField("articles", T.ArrayType(T.StructType(_fields("url", "title", "domain", "seendate"))))
])

FEED_B = T.StructType([
    T.StructField("articles", T.ArrayType(T.StructType(
        _fields("url", "title", "publishedAt")
        + [T.StructField("source", T.StructType(_fields("name")))]
    )))
])

EVENTS = T.StructType(_fields("event_name", "event_date"))
WINDOWS = T.StructType(_fields("name", "start", "end"))
