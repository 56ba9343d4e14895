"""Rules told by literal rows, apart from the shared SQL."""

import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, text
from tidewire.operators import scoring, study
from tidewire.plans import clean, collect
from tidewire.sources import gkg


@pytest.mark.parametrize("given, expected", [
    ("Mon, 05 Aug 2024 12:00:00 GMT", "2024-08-05T12:00:00+00:00"), ("August 5, 2024", "2024-08-05T00:00:00+00:00"),
    ("5 August 2024", "2024-08-05T00:00:00+00:00"), ("20240805T120000", "2024-08-05T12:00:00+00:00"),
    ("2024-8-5", "2024-08-05T00:00:00+00:00"), ("Aug 5, 2024", "2024-08-05T00:00:00+00:00"), ("5 Aug 2024", "2024-08-05T00:00:00+00:00"),
    ("soon", None), (None, None),
])
def test_date_texts(spark, given, expected):
    assert spark.createDataFrame([(given,)], "d string").select(dates.normalize_date(F.col("d"))).first()[0] == expected


def test_words_that_are_no_plurals(spark):
    words = "politics economics always perhaps texas christmas lens headquarters means markets studies boxes men".split()
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text.lemma(F.col("w"))).collect()
    assert [r[0] for r in got] == words[:9] + ["market", "study", "box", "man"]


def test_empty_date_is_kept_and_counted(spark):
    rows = [(1, "http://a/1", "", "x " * 60), (2, "http://a/2", "soon", "y " * 60), (3, "http://a/3", "2024-01-02", "z " * 60)]
    cleaned, report = clean.clean_articles(spark.createDataFrame(rows, "seq long, url string, published_at string, body string"))
    assert {r.seq: r.published_at for r in cleaned.collect()} == {1: "", 2: None, 3: "2024-01-02T00:00:00+00:00"}
    assert report.first().invalid_dates == 2


def test_damaged_archives_give_no_lines(spark):
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "one\ntwo\n" * 5000)
    good = whole.getvalue()
    broken = bytearray(good)
    broken[60:70] = b"\xff" * 10
    rows = [("good", good), ("broken", bytes(broken)), ("short", good[: len(good) // 2]), ("text", b"no archive"), ("empty", b"")]
    got = gkg.unzip_lines(spark.createDataFrame(rows, "path string, content binary")).groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in got} == {"good": 10_000}


def test_batch_scores_keep_their_rows(spark):
    def make():
        def score(texts):
            if "bad" in texts:
                raise ValueError
            return [("L", float(len(t))) for t in texts]
        return score

    rows = [(1, "abc"), (2, None), (3, "bad"), (4, "")]
    df = spark.createDataFrame(rows, "i int, t string").coalesce(1).select("i", scoring.batch_label_score(F.col("t"), make).alias("r"))
    assert {r.i: r.r.score for r in df.collect()} == {1: 3.0, 2: None, 3: None, 4: 0.0}


def test_feeds_are_not_cut_unless_asked(spark):
    listed_a = spark.range(1000).selectExpr("id AS seq", "concat('http://a/', id) AS url", "'t' AS title", "'d' AS domain", "'20240101T000000Z' AS seendate")
    listed_b = spark.range(300).selectExpr("id AS seq", "concat('http://b/', id) AS url", "'t' AS title", "named_struct('name', 's') AS source", "'2024-01-01' AS publishedAt")
    pages = spark.createDataFrame([], "url string, html string")
    stored = spark.createDataFrame([], "url string")
    assert collect.collect_feeds(stored, listed_a, listed_b, pages).count() == 1300
    assert collect.collect_feeds(stored, listed_a, listed_b, pages, caps={"a": 250, "b": 10}).count() == 260


def test_many_timed_events(spark):
    """Windows of events with times of day, against pandas."""
    events = spark.range(40).selectExpr("concat('e', id) AS event_name", "date_format(timestamp_seconds(1704067200 + id * 50021), \"yyyy-MM-dd'T'HH:mm:ssXXX\") AS event_date")
    articles = spark.range(3000).selectExpr("timestamp_seconds(1703500000 + id * 1009) AS published_at", "sin(id) AS sentiment_score")
    got = {r.event_name: r for r in study.window_stats_instants(articles, events).collect()}
    a = articles.selectExpr("unix_micros(published_at) AS t", "sentiment_score AS s").toPandas()
    day = 86_400_000_000
    for r in events.collect():
        p = pd.Timestamp(r.event_date).value // 1000
        for side, low, high in (("before", p - 7 * day, p), ("after", p, p + 7 * day)):
            s = a.s[(a.t >= low) & (a.t < high)]
            assert got[r.event_name][f"{side}_n"] == len(s)
            if len(s):
                assert got[r.event_name][f"{side}_mean"] == pytest.approx(s.mean())
