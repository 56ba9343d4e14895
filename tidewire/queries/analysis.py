"""Daily sentiment and event studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions.stats import t_two_sided
from tidewire.operators import aggregates, study
from tidewire.operators.filters import complete_rows
from tidewire.queries.inputs import ANCHOR_SQL, ARTICLES, anchors, articles, plain
from tidewire.queries.registry import query
from tidewire.session import scratch_path
from tidewire.sinks.writers import write_counted, write_dated

ART = plain(ARTICLES)
SCORED = f"""(SELECT *, CAST(published_at AS DATE) AS published_date FROM ({ART})
  WHERE sentiment_score IS NOT NULL AND NOT isnan(sentiment_score) AND topic IS NOT NULL AND published_at IS NOT NULL)"""
DAILY = f"""(SELECT topic, published_date, avg(sentiment_score) AS avg_sentiment,
  coalesce(stddev_samp(sentiment_score), 0) AS sentiment_std, count(url) AS article_count
  FROM {SCORED} GROUP BY topic, published_date)"""


def rounded(df, *columns: str, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def tail_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's t: the same integral, spelled over a list."""

    def integral(lo: str, hi: str) -> str:
        x = f"({lo} + i * (({hi}) - ({lo})) / 2000.0)"
        weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
        total = f"list_sum(list_transform(range(0, 2001), lambda i: {weight} * pow(greatest(cos({x}), 0), {df} - 1)))"
        return f"({total} * (({hi}) - ({lo})) / 6000.0)"

    lo = f"atan(abs({t}) / sqrt({df}))"
    reach = f"12.0 / sqrt({df})"
    return f"CASE WHEN {t} IS NOT NULL THEN least({integral(lo, f'least(pi() / 2, {lo} + {reach})')} / {integral('0', f'least(pi() / 2, {reach})')}, 1.0) END"


DAY_STATS = f"""(SELECT event_name, event_date,
    count(pre) AS n1, avg(pre) AS m1, var_samp(pre) AS v1, count(post) AS n2, avg(post) AS m2, var_samp(post) AS v2
  FROM (SELECT event_name, event_date,
      CASE WHEN published_date >= CAST(event_date AS DATE) - 7 AND published_date < CAST(event_date AS DATE)
           THEN sentiment_score END AS pre,
      CASE WHEN published_date > CAST(event_date AS DATE) AND published_date <= CAST(event_date AS DATE) + 7
           THEN sentiment_score END AS post
    FROM {ANCHOR_SQL} LEFT JOIN {SCORED} s
      ON s.published_date BETWEEN CAST(event_date AS DATE) - 7 AND CAST(event_date AS DATE) + 7)
  GROUP BY event_name, event_date)"""
INSTANT_STATS = f"""(SELECT event_name, event_date,
    count(pre) AS n1, avg(pre) AS m1, var_samp(pre) AS v1, count(post) AS n2, avg(post) AS m2, var_samp(post) AS v2
  FROM (SELECT event_name, event_date,
      CASE WHEN published_at < CAST(event_date AS TIMESTAMP) THEN sentiment_score END AS pre,
      CASE WHEN published_at >= CAST(event_date AS TIMESTAMP) THEN sentiment_score END AS post
    FROM {ANCHOR_SQL} LEFT JOIN ({ART}) s
      ON s.published_at >= CAST(event_date AS TIMESTAMP) - INTERVAL 7 DAY
     AND s.published_at < CAST(event_date AS TIMESTAMP) + INTERVAL 7 DAY)
  GROUP BY event_name, event_date)"""
WELCH = f"""(SELECT *, CASE WHEN n1 > 2 AND n2 > 2 THEN (m1 - m2) / sqrt(v1 / n1 + v2 / n2) END AS t,
    pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM {DAY_STATS})"""
STUDENT = f"""(SELECT *, CASE WHEN n1 >= 2 AND n2 >= 2
      THEN (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) END AS t,
    CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM {INSTANT_STATS})"""
STUDENT_P = f"(SELECT *, {tail_sql('t', 'df')} AS p FROM {STUDENT})"


def scored(t):
    return aggregates.scored_rows(articles(t))


@query("agg1_daily_sentiment", f"""SELECT topic, published_date, round(avg_sentiment, 6) AS avg_sentiment,
  round(sentiment_std, 6) AS sentiment_std, article_count FROM {DAILY}""")
def _(t):
    return rounded(aggregates.daily_sentiment(articles(t)), "avg_sentiment", "sentiment_std")


@query("agg2_event_window_stats", f"""SELECT event_name, event_date, n1 AS pre_n, round(m1, 6) AS pre_mean,
  round(v1, 4) AS pre_var, n2 AS post_n, round(m2, 6) AS post_mean, round(v2, 4) AS post_var FROM {DAY_STATS}""")
def _(t):
    s = study.window_stats_days(scored(t), anchors(t))
    return rounded(rounded(s, "pre_mean", "post_mean"), "pre_var", "post_var", places=4)


@query("agg3_welch_test", f"""SELECT event_name, round(t, 6) AS t_stat, round({tail_sql('t', 'df')}, 6) AS p_value
  FROM {WELCH}""")
def _(t):
    s = study.event_study_days(scored(t), anchors(t))
    return rounded(s.select("event_name", "t_stat", "p_value"), "t_stat", "p_value")


@query("agg4_student_test", f"""SELECT event_name, round_even(t, 4) AS t_statistic, round_even(p, 4) AS p_value
  FROM {STUDENT_P}""")
def _(t):
    s = study.event_study_instants(articles(t), anchors(t))
    return s.select("event_name", "t_statistic", "p_value")


@query("agg10_dropped_rows", f"""SELECT count(*) AS initial, count(*) - count(CASE WHEN sentiment_score IS NOT NULL
  AND topic IS NOT NULL AND published_at IS NOT NULL THEN 1 END) AS dropped FROM ({ART})""")
def _(t):
    return aggregates.dropped_rows(articles(t))


@query("agg11_volume_over_time", f"""SELECT published_date, CAST(sum(article_count) AS BIGINT) AS article_count
  FROM {DAILY} GROUP BY published_date""")
def _(t):
    return aggregates.articles_per_day(aggregates.daily_sentiment(articles(t)))


EVENT_DAYS = f"""SELECT event_name, side, day, round(avg(sentiment_score), 6) AS mean, count(*) AS n
  FROM (SELECT event_name, published_date AS day, sentiment_score,
      CASE WHEN published_date < CAST(event_date AS DATE) THEN 'pre' ELSE 'post' END AS side
    FROM {ANCHOR_SQL} JOIN {SCORED} s ON s.published_date BETWEEN CAST(event_date AS DATE) - 7 AND CAST(event_date AS DATE) + 7
     AND s.published_date <> CAST(event_date AS DATE))
  GROUP BY event_name, side, day"""


def days_of_events(rows, events):
    """Moments of the days around events; other days go before anything is aggregated."""
    days = study.event_days(events)
    dated = rows.withColumnRenamed("published_date", "day").join(days.select("day").distinct(), "day", "left_semi")
    joined = days.join(study.daily_moments(dated, "day"), "day")
    return rounded(joined.select("event_name", "side", "day", "mean", "n"), "mean")


@query("join1_event_days", EVENT_DAYS)
def _(t):
    return days_of_events(scored(t), anchors(t))


@query("join1_dated_table", EVENT_DAYS)
def _(t):
    """The same over a table with a folder for each day, of which those around events are opened."""
    path = scratch_path(t.spark, "by_day")
    write_dated(scored(t), path)
    return days_of_events(t.spark.read.parquet(path), anchors(t))


@query("agg11_rollup", f"""SELECT published_date, topic, grouping_id(published_date, topic)::INTEGER AS level, count(*) AS article_count,
  round(avg(sentiment_score) + 1e-9, 6) AS avg_sentiment, round(coalesce(stddev_samp(sentiment_score), 0), 6) AS sentiment_std
  FROM {SCORED} GROUP BY GROUPING SETS ((published_date, topic), (published_date), (topic), ())""")
def _(t):
    # Means of two-digit numbers often lie halfway between two roundings; the shift decides these alike whatever the order of the sum.
    found = aggregates.sentiment_rollup(articles(t)).withColumn("avg_sentiment", F.col("avg_sentiment") + 1e-9)
    return rounded(found, "avg_sentiment", "sentiment_std")


@query("agg11_before_and_after", f"""SELECT event_name, 'pre' AS side, n1 AS article_count, round(m1, 6) AS avg_sentiment FROM {DAY_STATS}
  UNION ALL SELECT event_name, 'post', n2, round(m2, 6) FROM {DAY_STATS}""")
def _(t):
    sides = F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_n").alias("article_count"), F.round(f"{s}_mean", 6).alias("avg_sentiment")) for s in ("pre", "post")]))
    return study.window_stats_days(scored(t), anchors(t)).select("event_name", sides)


@query("agg10_counted_write", f"""SELECT count(*) AS initial, count(*) - count(CASE WHEN sentiment_score IS NOT NULL
  AND topic IS NOT NULL AND published_at IS NOT NULL THEN 1 END) AS dropped FROM ({ART})""")
def _(t):
    """Counted while the complete rows are written, without a second job."""
    rows, path = articles(t), scratch_path(t.spark, "complete")
    lacking = aggregates.missing(rows)
    keep = lambda df: df.filter(~lacking).write.parquet(path)
    seen = write_counted(rows, keep, initial=F.count("*"), dropped=F.count_if(lacking))
    assert t.spark.read.parquet(path).count() == seen["initial"] - seen["dropped"]
    return t.spark.createDataFrame([(seen["initial"], seen["dropped"])], "initial long, dropped long")


@query("join2_event_instants", f"""SELECT event_name, event_date, n1 AS before_n, round(m1, 6) AS before_mean,
  n2 AS after_n, round(m2, 6) AS after_mean FROM {INSTANT_STATS}""")
def _(t):
    s = study.window_stats_instants(articles(t), anchors(t)).drop("before_var", "after_var")
    return rounded(s, "before_mean", "after_mean")


@query("flt8_complete_rows", f"SELECT url, topic, sentiment_score, published_at FROM {SCORED}")
def _(t):
    rows = complete_rows(articles(t), ["sentiment_score", "topic", "published_at"])
    return rows.select("url", "topic", "sentiment_score", "published_at")


@query("flt9_day_masks", f"""SELECT url, event_name, published_date < CAST(event_date AS DATE) AS is_pre
  FROM {ANCHOR_SQL} JOIN {SCORED} s ON s.published_date BETWEEN CAST(event_date AS DATE) - 7 AND CAST(event_date AS DATE) + 7
   AND s.published_date <> CAST(event_date AS DATE)""")
def _(t):
    days = study.event_days(anchors(t)).withColumnRenamed("day", "published_date")
    joined = scored(t).join(F.broadcast(days), "published_date")
    return joined.select("url", "event_name", (F.col("side") == "pre").alias("is_pre"))


@query("flt10_instant_masks", f"""SELECT event_name, count(CASE WHEN published_at < CAST(event_date AS TIMESTAMP) THEN 1 END) AS before_rows,
    count(CASE WHEN published_at >= CAST(event_date AS TIMESTAMP) THEN 1 END) AS after_rows
  FROM {ANCHOR_SQL} LEFT JOIN (SELECT * FROM ({ART}) WHERE sentiment_score IS NOT NULL) s
    ON s.published_at >= CAST(event_date AS TIMESTAMP) - INTERVAL 7 DAY
   AND s.published_at < CAST(event_date AS TIMESTAMP) + INTERVAL 7 DAY
  GROUP BY event_name""")
def _(t):
    s = study.window_stats_instants(articles(t), anchors(t))
    return s.select("event_name", F.col("before_n").alias("before_rows"), F.col("after_n").alias("after_rows"))


@query("flt11_sample_gate", f"""SELECT event_name, n1 > 2 AND n2 > 2 AS tested,
  CASE WHEN n1 > 2 AND n2 > 2 THEN round(m2 - m1, 6) END AS shift FROM {DAY_STATS}""")
def _(t):
    s = study.event_study_days(scored(t), anchors(t))
    return s.select(
        "event_name", ((F.col("pre_7d_volume") > 2) & (F.col("post_7d_volume") > 2)).alias("tested"),
        F.round("sentiment_shift_mean", 6).alias("shift"),
    )


@query("flt12_null_scores_in_window", f"""SELECT CAST(published_at AS DATE) AS day, count(sentiment_score) AS n,
  round(avg(sentiment_score), 6) AS mean FROM ({ART}) WHERE published_at IS NOT NULL GROUP BY 1 HAVING count(sentiment_score) > 0""")
def _(t):
    dated = articles(t).filter("published_at IS NOT NULL").withColumn("day", F.to_date("published_at"))
    return rounded(study.daily_moments(dated, "day").select("day", "n", "mean"), "mean")


@query("prj9_instant_result_row", f"""SELECT event_name, event_date, round_even(m1, 4) AS before_mean,
    round_even(m2, 4) AS after_mean, n1 AS before_count, n2 AS after_count,
    CASE WHEN t <> 0 THEN round_even(t, 4) END AS t_statistic, CASE WHEN p <> 0 THEN round_even(p, 4) END AS p_value,
    coalesce(p < 0.05 AND p <> 0, FALSE) AS significant FROM {STUDENT_P}""")
def _(t):
    return study.event_study_instants(articles(t), anchors(t))


@query("prj10_event_column_names", f"""SELECT event_name, event_date, n1 + n2 AS n FROM {INSTANT_STATS}""")
def _(t):
    other = anchors(t).withColumnsRenamed({"event_name": "name", "event_date": "date"})
    s = study.event_study_instants(articles(t), other)
    return s.select("event_name", "event_date", (F.col("before_count") + F.col("after_count")).alias("n"))


@query("prj11_day_result_row", f"""SELECT event_name, event_date, n1 AS pre_7d_volume, n2 AS post_7d_volume,
    CASE WHEN n1 > 2 AND n2 > 2 THEN round(m2 - m1, 6) END AS sentiment_shift_mean, round(t, 6) AS t_stat,
    round({tail_sql('t', 'df')}, 6) AS p_value FROM {WELCH}""")
def _(t):
    return rounded(study.event_study_days(scored(t), anchors(t)), "sentiment_shift_mean", "t_stat", "p_value")


@query("lim6_daily_order", f"""SELECT topic, published_date, article_count,
  CAST(row_number() OVER (PARTITION BY topic ORDER BY published_date) AS INTEGER) AS place FROM {DAILY}""")
def _(t):
    from pyspark.sql import Window as W

    daily = aggregates.daily_sentiment(articles(t))
    place = F.row_number().over(W.partitionBy("topic").orderBy("published_date"))
    return daily.select("topic", "published_date", "article_count", place.alias("place")).orderBy("topic", "published_date")


@query("scl22_instant_to_date", f"SELECT event_id, CAST(published_at AS DATE) AS day FROM ({ART})")
def _(t):
    return articles(t).select("event_id", F.to_date("published_at").alias("day"))


@query("scl23_date_shift", f"""SELECT event_id, CAST(published_at AS DATE) - 7 AS week_before,
  CAST(published_at AS DATE) + 7 AS week_after FROM ({ART})""")
def _(t):
    day = F.to_date("published_at")
    return articles(t).select("event_id", F.date_sub(day, 7).alias("week_before"), F.date_add(day, 7).alias("week_after"))


@query("scl24_instant_shift", f"""SELECT event_id, published_at - INTERVAL 7 DAY AS week_before,
  published_at + INTERVAL 7 DAY AS week_after FROM ({ART})""")
def _(t):
    week = F.make_dt_interval(F.lit(7))
    return articles(t).select(
        "event_id", (F.col("published_at") - week).alias("week_before"), (F.col("published_at") + week).alias("week_after")
    )


@query("scl25_date_text", f"SELECT event_id, CAST(CAST(published_at AS DATE) AS VARCHAR) AS day_text FROM ({ART})")
def _(t):
    return articles(t).select("event_id", F.to_date("published_at").cast("string").alias("day_text"))


@query("scl26_single_day_deviation", """SELECT CAST(user_id AS VARCHAR) AS topic, CAST(ts AS DATE) AS published_date,
  round(coalesce(stddev_samp(value), 0), 6) AS sentiment_std, count(*) AS article_count FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def _(t):
    by_user = t.events.select(
        F.col("user_id").cast("string").alias("topic"), F.col("value").alias("sentiment_score"),
        F.col("ts").alias("published_at"), F.col("event_id").alias("url"),
    )
    return rounded(aggregates.daily_sentiment(by_user).drop("avg_sentiment"), "sentiment_std")


@query("scl27_round_half_even", "SELECT event_id, round_even(event_id / 32.0::DOUBLE, 4) AS rounded FROM events")
def _(t):
    return t.events.select("event_id", F.bround(F.col("event_id") / 32, 4).alias("rounded"))


@query("scl28_significant", f"SELECT event_name, coalesce(p < 0.05 AND p <> 0, FALSE) AS significant FROM {STUDENT_P}")
def _(t):
    return study.event_study_instants(articles(t), anchors(t)).select("event_name", "significant")


@query("scl31_t_tail", f"""SELECT event_type, round({tail_sql('t', 'df')}, 6) AS p FROM (
  SELECT event_type, avg(value) / (stddev_samp(value) / sqrt(count(*))) / 40 AS t, CAST(count(*) - 1 AS DOUBLE) AS df
  FROM events GROUP BY event_type)""")
def _(t):
    per_type = t.events.groupBy("event_type").agg(
        (F.avg("value") / (F.stddev_samp("value") / F.sqrt(F.count("*"))) / 40).alias("t"),
        (F.count("*") - 1).cast("double").alias("df"),
    )
    return per_type.select("event_type", F.round(t_two_sided(F.col("t"), F.col("df")), 6).alias("p"))


@query("src10_event_anchors", f"""SELECT event_name, event_date, count(event_id) AS articles_that_day
  FROM {ANCHOR_SQL} LEFT JOIN events e ON CAST(e.ts AS DATE) = CAST(event_date AS DATE) GROUP BY event_name, event_date""")
def _(t):
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("articles_that_day"))
    joined = anchors(t).join(days, F.to_date("event_date") == F.col("day"), "left")
    return joined.select("event_name", "event_date", F.coalesce("articles_that_day", F.lit(0)).alias("articles_that_day"))


def analysis_table(t, name: str):
    from tidewire.plans.export import analysis_tables

    return analysis_tables(articles(t), anchors(t))[name]


@query("stg8_article_table", f"SELECT url, published_at, topic, sentiment_score FROM {SCORED}")
def _(t):
    return analysis_table(t, "articles").select("url", "published_at", "topic", "sentiment_score")


@query("stg8_daily_table", f"""SELECT topic, CAST(published_date AS VARCHAR) AS published_date, round(avg_sentiment, 6) AS avg_sentiment,
  round(sentiment_std, 6) AS sentiment_std, article_count FROM {DAILY}""")
def _(t):
    return rounded(analysis_table(t, "daily_sentiment_aggregation"), "avg_sentiment", "sentiment_std")


@query("stg8_event_table", f"""SELECT event_name, event_date, n1 AS pre_7d_volume, n2 AS post_7d_volume,
    CASE WHEN n1 > 2 AND n2 > 2 THEN round(m2 - m1, 6) END AS sentiment_shift_mean, round(t, 6) AS t_stat,
    round({tail_sql('t', 'df')}, 6) AS p_value FROM {WELCH}""")
def _(t):
    return rounded(analysis_table(t, "events"), "sentiment_shift_mean", "t_stat", "p_value")


@query("stg8_analysis_tables", f"""SELECT 'articles' AS name, count(*) AS n, round(sum(sentiment_score), 4) AS total FROM {SCORED}
  UNION ALL SELECT 'daily_sentiment_aggregation', count(*), round(sum(avg_sentiment), 4) FROM {DAILY}
  UNION ALL SELECT 'events', count(*), round(sum(m2 - m1), 4) FROM {DAY_STATS}""")
def _(t):
    from tidewire.plans.export import analysis_tables

    made = analysis_tables(articles(t), anchors(t))
    measure = {"articles": "sentiment_score", "daily_sentiment_aggregation": "avg_sentiment", "events": "sentiment_shift_mean"}
    parts = [
        made[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.round(F.sum(c), 4).alias("total"))
        for name, c in measure.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
