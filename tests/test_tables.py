"""Dated tables, first rows without a sort, counters that pass by, main text and JSON arrays."""

import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import quota, study, topics
from tidewire.plans.topics import model_topics
from tidewire.sinks import writers
from tidewire.sources import pages, tables

DAY = date(2024, 3, 1)


def scores(spark, days=60, per_day=5):
    rows = [(DAY + timedelta(i), float(i % 7) + j / 10) for i in range(days) for j in range(per_day)]
    return spark.createDataFrame(rows, "published_date date, sentiment_score double")


def test_study_opens_the_days_around_events_only(spark, tmp_path):
    path = str(tmp_path / "dated")
    writers.write_dated(scores(spark), path)
    events = spark.createDataFrame([("e", "2024-03-20")], "event_name string, event_date string")
    stats = study.window_stats_days(spark.read.parquet(path), events)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    row = stats.first()
    assert (row.pre_n, row.post_n) == (35, 35)
    # Without the other folders the result is the same.
    import shutil

    for i in (0, 1, 30, 59):
        shutil.rmtree(f"{path}/published_date={DAY + timedelta(i)}")
    assert study.window_stats_days(spark.read.parquet(path), events).first() == row


def test_one_day_written_again_replaces_that_day_only(spark, tmp_path):
    path = str(tmp_path / "dated")
    writers.write_dated(scores(spark, 4), path)
    again = spark.createDataFrame([(DAY, -5.0)], "published_date date, sentiment_score double")
    for _ in range(2):
        writers.write_dated(again, path)
    found = spark.read.parquet(path)
    assert found.filter(F.col("published_date") == F.lit(DAY)).collect()[0].sentiment_score == -5.0 and found.count() == 16


@pytest.mark.parametrize("few, parts", [(10_000, 100), (20, 7), (1, 2)])
def test_nth_smallest(spark, monkeypatch, few, parts):
    monkeypatch.setattr(quota, "FEW", few)
    monkeypatch.setattr(quota, "PARTS", parts)
    rng = random.Random(few)
    values = [rng.randrange(-(10**12), 10**12) for _ in range(150)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "seq long").repartition(3)
    ordered = sorted(v for v in values if v is not None)
    for n in (1, 2, 75, 149, 150):
        assert quota.nth_smallest(df, "seq", n) == ordered[n - 1]
        assert sorted(r.seq for r in quota.first_rows(df, "seq", n).collect()) == ordered[:n]
    assert quota.nth_smallest(df, "seq", 151) is None and quota.first_rows(df, "seq", 0).count() == 0
    plan = quota.first_rows(df, "seq", 75)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan


def test_nth_of_equal_numbers(spark, monkeypatch):
    monkeypatch.setattr(quota, "FEW", 3)
    df = spark.createDataFrame([(7,)] * 50 + [(1,), (9,)], "seq long")
    assert [quota.nth_smallest(df, "seq", n) for n in (1, 2, 51, 52)] == [1, 7, 7, 9]


def test_counters_pass_by_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.range(100).mapInPandas(look, "id long")
    seen = writers.write_counted(rows, lambda df: df.filter("id >= 30").write.parquet(str(tmp_path / "x")), n=F.count("*"), low=F.count_if(F.col("id") < 30))
    assert seen == {"n": 100, "low": 30} and read.value == 100 and spark.read.parquet(str(tmp_path / "x")).count() == 70


def test_main_text(spark):
    cases = {
        "<body><header>Site</header><article><p>one</p></article><p>other</p><footer>f</footer></body>": "one",
        "<main><p>a</p><aside>b</aside></main>rest": "a",
        "<article>x</article><main>y</main><article>z</article>": "x z",
        "<div><a href=1>link</a> <a href=2>link</a> and</div><div>text with a <a href=3>link</a></div>": "text with a link",
        "<form><p>search</p></form>plain &amp; simple": "plain & simple",
        "<p><p><p>": "", "": "",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "html string")
    found = {r.html: r.body for r in df.select("html", pages.page_text(F.col("html")).alias("body")).collect()}
    assert found == cases | {None: ""}


def test_json_arrays(spark, tmp_path):
    df = spark.range(10).select(F.concat(F.lit('u"\n'), F.col("id").cast("string")).alias("url"), F.lit(1.5).alias("gdelt_tone")).repartition(3)
    writers.write_json_arrays(df, str(tmp_path / "a"))
    files = sorted((tmp_path / "a").glob("part-*"))
    assert sum(len(json.loads(f.read_text())) for f in files) == 10
    back = tables.read_articles_json(spark, str(tmp_path / "a"), array=True)
    assert sorted(r.url for r in back.collect()) == [f'u"\n{i}' for i in range(10)]
    writers.write_json_arrays(df.limit(0), str(tmp_path / "b"))
    assert tables.read_articles_json(spark, str(tmp_path / "b"), array=True).count() == 0


def test_far_vectors_are_outliers(spark):
    rows = [(i, [100.0 * (i % 3), float(i % 10)], "x", f"word{i % 3} a b") for i in range(90)] + [(100 + i, [100.0 * (i % 3), 60.0], "x", "w") for i in range(3)]
    df = spark.createDataFrame(rows, "seq long, v array<double>, headline string, cleaned_body string")
    found = topics.assign_topics(topics.array_vectors(df, "v"), k=range(2, 7), outlier_quantile=0.9).collect()
    assert {r.seq for r in found if r.topic_id == -1} == {100, 101, 102}
    assert len({r.topic_id for r in found}) == 4
    labelled = model_topics(df, k=range(2, 7), embedding="v", outlier_quantile=0.9).collect()
    assert {r.seq for r in labelled if r.topic == "Outlier"} == {100, 101, 102}
    # Without the limit they belong to a topic.
    assert all(r.topic_id >= 0 for r in topics.assign_topics(topics.array_vectors(df, "v"), k=3).collect())
