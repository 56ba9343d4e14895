"""Event studies, daily sentiment and their plans on edge rows."""

import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import aggregates, study

DAY = datetime(2024, 8, 5)


def scored(spark, rows):
    return spark.createDataFrame(
        [(f"u{i}", "t", s, d.strftime("%Y-%m-%dT%H:%M:%S+00:00") if d else None) for i, (d, s) in enumerate(rows)],
        "url string, topic string, sentiment_score double, published_at string",
    )


def anchors(spark, *dates):
    return spark.createDataFrame([(f"e{i}", d) for i, d in enumerate(dates)], "event_name string, event_date string")


def day_study(spark, rows, *dates):
    articles = aggregates.scored_rows(scored(spark, rows))
    return {r["event_name"]: r for r in study.event_study_days(articles, anchors(spark, *dates)).collect()}


def test_day_windows_leave_out_the_event_day(spark):
    at = [DAY - timedelta(8), DAY - timedelta(7), DAY, DAY + timedelta(hours=12), DAY + timedelta(7), DAY + timedelta(7, hours=12), DAY + timedelta(8)]
    got = day_study(spark, [(d, 1.0) for d in at], "2024-08-05", "2030-01-01")
    assert (got["e0"]["pre_7d_volume"], got["e0"]["post_7d_volume"]) == (1, 2)
    assert got["e0"]["t_stat"] is None and got["e0"]["sentiment_shift_mean"] is None
    assert (got["e1"]["pre_7d_volume"], got["e1"]["post_7d_volume"]) == (0, 0)


def test_welch_has_the_opposite_sign_of_the_shift(spark):
    pre, post = [0.1, 0.2, 0.4, 0.3], [0.6, 0.9, 0.7]
    rows = [(DAY - timedelta(i + 1), s) for i, s in enumerate(pre)] + [(DAY + timedelta(i + 1), s) for i, s in enumerate(post)]
    got = day_study(spark, rows, "2024-08-05")["e0"]
    a, b = statistics.variance(pre) / 4, statistics.variance(post) / 3
    assert got["t_stat"] == pytest.approx((statistics.mean(pre) - statistics.mean(post)) / (a + b) ** 0.5)
    assert got["sentiment_shift_mean"] == pytest.approx(statistics.mean(post) - statistics.mean(pre))
    assert 0 < got["p_value"] < 0.05


def test_same_event_listed_twice_gives_two_equal_rows(spark):
    rows = [(DAY - timedelta(1), 0.5)] * 3
    twice = anchors(spark, "2024-08-05").unionByName(anchors(spark, "2024-08-05"))
    got = study.event_study_days(aggregates.scored_rows(scored(spark, rows)), twice).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["pre_7d_volume"] == 3


def instant_study(spark, rows, *dates):
    return {r["event_name"]: r for r in study.event_study_instants(scored(spark, rows), anchors(spark, *dates)).collect()}


def test_instant_windows_are_half_open(spark):
    at = [DAY - timedelta(7), DAY - timedelta(7, seconds=1), DAY - timedelta(seconds=1), DAY, DAY + timedelta(hours=12), DAY + timedelta(7)]
    got = instant_study(spark, [(d, float(i)) for i, d in enumerate(at)], "2024-08-05", "2030-01-01")
    assert (got["e0"]["before_count"], got["e0"]["after_count"]) == (2, 2)
    assert (got["e0"]["before_mean"], got["e0"]["after_mean"]) == (1.0, 3.5)
    assert got["e1"]["before_count"] == 0 and got["e1"]["before_mean"] is None and got["e1"]["significant"] is False


def test_event_with_a_time_of_day(spark):
    at = [DAY - timedelta(hours=1), DAY + timedelta(hours=5), DAY + timedelta(hours=7), DAY + timedelta(7, hours=5), DAY + timedelta(7, hours=7)]
    got = instant_study(spark, [(d, 1.0) for d in at], "2024-08-05T06:00:00", "2024-08-05")
    assert (got["e0"]["before_count"], got["e0"]["after_count"]) == (2, 2)
    assert (got["e1"]["before_count"], got["e1"]["after_count"]) == (1, 2)


def test_zero_statistic_and_single_rows(spark):
    equal = [(DAY - timedelta(hours=h), s) for h, s in ((1, 0.0), (2, 1.0))] + [(DAY + timedelta(hours=h), s) for h, s in ((1, 0.0), (2, 1.0))]
    got = instant_study(spark, equal, "2024-08-05")["e0"]
    assert got["t_statistic"] is None and got["p_value"] == 1.0 and got["significant"] is False
    flat = [(DAY - timedelta(hours=h), 0.5) for h in (1, 2)] + [(DAY + timedelta(hours=h), 0.5) for h in (1, 2)]
    got = instant_study(spark, flat, "2024-08-05")["e0"]
    assert got["t_statistic"] is None and got["p_value"] is None
    got = instant_study(spark, equal[:1] + equal[2:], "2024-08-05")["e0"]
    assert got["before_mean"] == 0.0 and got["t_statistic"] is None


def test_missing_and_nan_scores_do_not_count(spark):
    rows = [(DAY - timedelta(hours=h), s) for h, s in ((1, None), (2, float("nan")), (3, 0.25), (4, 0.75))]
    got = instant_study(spark, rows, "2024-08-05")["e0"]
    assert got["before_count"] == 2 and got["before_mean"] == 0.5


def test_mixed_date_texts_are_all_read(spark):
    rows = [("2024-08-04T00:00:00+00:00", 1.0), ("2024-08-04", 2.0), ("2024-08-04T01:02:03.5Z", 3.0), ("bad", 4.0), (None, 5.0)]
    articles = spark.createDataFrame(rows, "published_at string, sentiment_score double")
    got = study.event_study_instants(articles, anchors(spark, "2024-08-05")).first()
    assert (got["before_count"], got["before_mean"]) == (3, 2.0)


def test_daily_deviation_of_one_article_is_zero(spark):
    rows = [(DAY, 0.5), (DAY + timedelta(1), 0.1), (DAY + timedelta(1), 0.3), (None, 0.5), (DAY, None), (DAY, float("nan"))]
    got = {str(r["published_date"]): r for r in aggregates.daily_sentiment(scored(spark, rows)).collect()}
    assert got["2024-08-05"]["sentiment_std"] == 0.0 and got["2024-08-05"]["article_count"] == 1
    assert got["2024-08-06"]["sentiment_std"] == pytest.approx(statistics.stdev([0.1, 0.3]))
    assert aggregates.dropped_rows(scored(spark, rows)).first()["dropped"] == 3


def test_studies_join_by_equality(spark):
    articles = scored(spark, [(DAY, 0.5)])
    for df in (
        study.event_study_days(aggregates.scored_rows(articles), anchors(spark, "2024-08-05")),
        study.event_study_instants(articles, anchors(spark, "2024-08-05")),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_parquet_scan_is_pruned(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    articles = events.select(F.col("event_type").alias("topic"), F.col("value").alias("sentiment_score"),
                             F.col("ts").alias("published_at"), F.col("event_id").alias("url"))
    daily = aggregates.daily_sentiment(articles).drop("article_count")
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "user_id" not in plan
    assert "IsNotNull(value)" in plan.split("PushedFilters")[1].split("]")[0]
