"""Relations the queries run on, derived from the given tables.

Each is SQL that Spark and DuckDB both understand. In Spark the table names
stand in braces, see ``Tables.sql``; ``plain`` takes them off for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.queries.registry import Tables
from tidewire.sources.gkg import parse_lines

ANCHORS = [("Early peak", "2024-01-10"), ("Late peak", "2024-01-20"), ("Quiet spring", "2024-03-01")]
ANCHOR_SQL = "(VALUES " + ", ".join(f"('{n}', '{d}')" for n, d in ANCHORS) + ") AS a(event_name, event_date)"

# Events seen as scored articles; some lack a score, a topic or a date.
ARTICLES = """
SELECT event_id, CAST(event_id AS STRING) AS url,
  CASE WHEN event_id % 101 = 0 THEN NULL ELSE event_type END AS topic,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS sentiment_score,
  CASE WHEN event_id % 103 = 0 THEN NULL ELSE ts END AS published_at
FROM {events}"""

# Pages seen as feed lines: every page is listed in two of 96 slots.
FEED_FIELDS = """
SELECT line_no, file_no, page_id,
  CASE WHEN page_id % 17 = 0 THEN 'notadate'
       ELSE '202401' || lpad(CAST(1 + page_id % 30 AS STRING), 2, '0') || '001500' END AS date_f,
  CASE WHEN page_id % 13 = 0 THEN '' WHEN page_id % 14 = 1 THEN 'NA'
       ELSE ' ' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '  ' END AS source_f,
  CASE WHEN page_id % 31 = 3 THEN 'null' WHEN page_id % 29 = 5 THEN 'ftp://host/' || CAST(page_id AS STRING)
       WHEN page_id % 27 = 4 THEN ' ' || url || '/fed-watch' ELSE url END AS url_f,
  CASE page_id % 8 WHEN 0 THEN 'ECON_INFLATION;TAX_POLICY' WHEN 1 THEN 'ELECTION;GENERAL' WHEN 2 THEN 'WB_Climate'
       WHEN 3 THEN 'SPORT;LEISURE' WHEN 4 THEN 'Gdp;UNEMPLOYMENT' WHEN 5 THEN 'MUSIC;ART' WHEN 6 THEN 'Federal Reserve'
       ELSE '' END AS themes_f,
  CASE WHEN page_id % 23 = 0 THEN '' WHEN page_id % 19 = 0 THEN 'abc,1'
       ELSE CAST(page_id % 21 - 10 AS STRING) || '.5,1,2' END AS tone_f
FROM (SELECT 2 * page_id AS line_no, page_id % 96 AS file_no, page_id, url FROM {pages}
      UNION ALL
      SELECT 2 * page_id + 1, (page_id * 7 + 13) % 96, page_id, url FROM {pages})"""

# The same as raw lines of 27 fields, some longer, shorter or blank.
FEED_LINES = f"""
SELECT line_no, file_no, page_id,
  CASE WHEN page_id % 41 = 7 THEN ''
       WHEN page_id % 37 = 6 THEN date_f || repeat(chr(9), 3) || source_f || chr(9) || url_f
       ELSE date_f || repeat(chr(9), 3) || source_f || chr(9) || url_f || repeat(chr(9), 3) || themes_f
            || repeat(chr(9), 8) || tone_f || repeat(chr(9), CASE WHEN page_id % 11 = 0 THEN 14 ELSE 11 END) END AS value
FROM ({FEED_FIELDS})"""

# Pages seen as stored articles with untidy URLs and dates; every page occurs twice.
RAW_ARTICLES = """
SELECT 2 * page_id + copy AS seq,
  CASE WHEN page_id % 43 = 2 THEN '' WHEN page_id % 47 = 3 THEN NULL WHEN copy = 1 THEN url || '#again' ELSE url END AS url,
  CASE page_id % 6 WHEN 0 THEN '2024-01-' || lpad(CAST(1 + page_id % 28 AS STRING), 2, '0') || 'T10:20:30+02:00'
    WHEN 1 THEN '202401' || lpad(CAST(1 + page_id % 28 AS STRING), 2, '0') || 'T102030Z'
    WHEN 2 THEN '2024-01-' || lpad(CAST(1 + page_id % 28 AS STRING), 2, '0')
    WHEN 3 THEN '2024-01-' || lpad(CAST(1 + page_id % 28 AS STRING), 2, '0') || ' 10:20'
    WHEN 4 THEN CASE WHEN page_id % 5 = 0 THEN '' ELSE 'yesterday' END ELSE NULL END AS published_at,
  html
FROM (SELECT page_id, url, html, 0 AS copy FROM {pages} UNION ALL SELECT page_id, url, html, 1 FROM {pages})"""


def plain(sql: str) -> str:
    """The SQL as DuckDB reads it."""
    for name in ("events", "pages", "documents", "labels", "embeddings", "conversations"):
        sql = sql.replace("{" + name + "}", name)
    return sql


def articles(t: Tables) -> DataFrame:
    return t.sql(ARTICLES, "events")


def anchors(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(ANCHORS, "event_name string, event_date string")


def feed_lines(t: Tables) -> DataFrame:
    return t.sql(FEED_LINES, "pages")


def parsed_feed(t: Tables) -> DataFrame:
    return parse_lines(feed_lines(t))


def raw_articles(t: Tables) -> DataFrame:
    return t.sql(RAW_ARTICLES, "pages")


def slots(t: Tables) -> DataFrame:
    """The 96 slots of a day, in reading order."""
    return t.spark.range(96).select(F.col("id").alias("file_no"), F.col("id").alias("slot"))


# Parsed feed lines in DuckDB's terms.
_part = lambda i: f"string_split(value, chr(9))[{i}]"
_null = lambda c: f"CASE WHEN {c} NOT IN (SELECT unnest(['', 'NA', 'null'])) THEN {c} END"
PARSED = f"""
SELECT line_no, file_no, page_id, {_null(_part(1))} AS date, {_null(_part(4))} AS source, {_null(_part(5))} AS url,
  {_null(_part(8))} AS themes, {_null(_part(16))} AS tone_csv
FROM ({plain(FEED_LINES)}) WHERE value <> ''"""

# The article record of a parsed line in DuckDB's terms.
ARTICLE_FIELDS = """
  trim(coalesce(url, 'nan')) AS url, trim(coalesce(source, 'nan')) AS source, '' AS headline,
  CASE WHEN try_strptime(left(date, 8), '%Y%m%d') IS NOT NULL
       THEN strftime(try_strptime(left(date, 8), '%Y%m%d'), '%Y-%m-%dT%H:%M:%SZ') END AS published_at,
  '' AS body, coalesce(themes, 'nan') AS themes"""
TONE = """CASE WHEN tone_csv IS NULL THEN CAST('nan' AS DOUBLE)
  ELSE coalesce(TRY_CAST(split_part(tone_csv, ',', 1) AS DOUBLE), 0.0) END"""


def keyword_sql(c: str, keywords) -> str:
    return "(" + " OR ".join(f"contains({c}, '{k}')" for k in keywords) + ")"
