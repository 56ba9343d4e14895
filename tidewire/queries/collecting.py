"""Feed scans, filters on feed lines, quotas, merges, pages, sinks and the stages built from them."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire import defaults
from tidewire.functions import dates, fields
from tidewire.operators import aggregates, dedup, filters, merge, quota
from tidewire.plans import collect
from tidewire.queries import sqltext as S
from tidewire.queries.analysis import DAILY, SCORED, STUDENT_P, rounded
from tidewire.queries.inputs import (
    ARTICLE_FIELDS, FEED_LINES, PARSED, TONE, anchors, articles, feed_lines, keyword_sql, parsed_feed, plain, slots,
)
from tidewire.queries.corpus import CLEAN_URL, band_sql, greedy_sql
from tidewire.queries.registry import query, quoted
from tidewire.queries.textual import VOWELS, _toy_scorer
from tidewire.functions.text import COMMENT, SPACES, TAG, element_pattern
from tidewire.session import scratch_path
from tidewire.sinks import store, writers
from tidewire.sources import archives, feeds, gkg, pages, tables
from tidewire.sources import slots as slot_lists

STAMP = "2024-06-01 12:00:00"


def stamp():
    return F.lit(STAMP).cast("timestamp")


BULK = keyword_sql("lower(coalesce(themes, 'nan') || ' ' || coalesce(url, 'nan'))", defaults.BULK_KEYWORDS)
HISTORICAL = f"""({keyword_sql("lower(coalesce(themes, 'nan'))", defaults.HISTORICAL_KEYWORDS)}
  OR {keyword_sql("lower(coalesce(url, 'nan'))", defaults.HISTORICAL_KEYWORDS)})"""
WEB = "url IS NOT NULL AND starts_with(trim(url), 'http')"

# --- scans ---------------------------------------------------------------------------------------


def landed(t, marker: str | None = None) -> str:
    """Write the feed lines as one folder per slot; ``marker`` turns into a byte that is no UTF-8."""
    path = scratch_path(t.spark, "gkg")
    value = F.col("value")
    if marker:
        value = F.replace(value, F.lit(marker), F.unhex(F.lit("FF")).cast("string"))
    lines = feed_lines(t).select(value.alias("value"), F.col("file_no").alias("slot"))
    # Gather the lines of a slot first, else every task would write a file for every slot.
    lines.repartition("slot").write.partitionBy("slot").text(path)
    return path


@query("src1_gkg_scan", f"SELECT CAST(file_no AS INTEGER) AS slot, date, source, url, themes, tone_csv FROM ({PARSED})")
def _(t):
    return gkg.read_gkg(t.spark, landed(t)).select("slot", "date", "source", "url", "themes", "tone_csv")


LAYOUT = "slot={slot}/*.txt"


def landed_in_order(t) -> str:
    """Write the feed lines as one folder and file per slot, lines in order."""
    path = scratch_path(t.spark, "slots")
    lines = feed_lines(t).select(F.format_string("%014d", "file_no").alias("slot"), "line_no", "value")
    ordered = lines.repartition("slot").sortWithinPartitions("slot", "line_no").drop("line_no")
    ordered.write.partitionBy("slot").text(path)
    return path


def named_slots(t, where: str = "true"):
    return slots(t).filter(where).select("file_no", F.format_string("%014d", "slot").alias("slot"))


@query("src1_listed_slots", f"""SELECT lpad(CAST(file_no AS VARCHAR), 14, '0') AS slot, row_number() OVER (PARTITION BY file_no ORDER BY line_no) AS place,
  date, source, url, themes, tone_csv FROM ({PARSED}) WHERE file_no % 5 = 2""")
def _(t):
    rows = gkg.read_slots(t.spark, landed_in_order(t), named_slots(t, "file_no % 5 = 2"), LAYOUT)
    place = F.row_number().over(Window.partitionBy("slot").orderBy("line_no")).cast("long")
    return rows.withColumn("place", place).select("slot", "place", "date", "source", "url", "themes", "tone_csv")


@query("src2_gkg_scan_filtered", f"""SELECT replace(url, 'x', chr(65533)) AS url, replace(themes, 'x', chr(65533)) AS themes FROM ({PARSED})
  WHERE url IS NOT NULL AND {HISTORICAL}""")
def _(t):
    rows = gkg.read_gkg(t.spark, landed(t, "x"))
    return rows.filter(F.col("url").isNotNull() & filters.mentions_either(F.col("themes"), F.col("url"))).select("url", "themes")


def landed_archives(t, part: str = "true", folder: str | None = None) -> str:
    """Zip the feed lines into archives on disk, one for the lines of 50 pages, about as one landed file would hold."""
    folder = folder or scratch_path(t.spark, "zips")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("feed.csv", "\n".join(pdf.sort_values("line_no")["value"]) + "\n")
        where, inner = fs.FileSystem.from_uri(folder)
        where.create_dir(inner, recursive=True)
        with where.open_output_stream(f"{inner}/slot-{pdf['archive'].iloc[0]}.zip") as out:
            out.write(data.getvalue())
        return pdf[["archive"]].head(1)

    lines = feed_lines(t).withColumn("archive", F.floor(F.col("page_id") / 50)).filter(part)
    lines.groupBy("archive").applyInPandas(write, "archive long").count()
    return folder


@query("src3_zip_members", f"""SELECT 'slot-' || (page_id // 50) || '.zip' AS path,
  row_number() OVER (PARTITION BY page_id // 50 ORDER BY line_no) - 1 AS line_no, url, tone_csv
  FROM (SELECT l.line_no, l.page_id, p.url, p.tone_csv, l.value FROM ({plain(FEED_LINES)}) l LEFT JOIN ({PARSED}) p USING (line_no))
  QUALIFY value <> ''""")
def _(t):
    name = F.substring_index("path", "/", -1).alias("path")
    return archives.read_zipped_gkg(t.spark, landed_archives(t)).select(name, "line_no", "url", "tone_csv")


@query("src4_recent_slots", """SELECT CAST(i AS INTEGER) AS file_no, strftime(time_bucket(INTERVAL 15 MINUTE, last) - i * INTERVAL 15 MINUTE, '%Y%m%d%H%M%S') AS slot
  FROM (SELECT max(ts) AS last FROM events), range(300) r(i)""")
def _(t):
    last = t.events.agg(F.max("ts").cast("timestamp").alias("last"))
    return slot_lists.recent_slots(last, F.col("last"), 300)


WINDOWS_SQL = "SELECT event_type AS name, date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events GROUP BY event_type"


def window_table(t):
    hour = lambda c: dates.slot_name(F.date_trunc("hour", c).cast("timestamp"))
    return t.events.groupBy(F.col("event_type").alias("name")).agg(
        hour(F.min("ts")).alias("start"), hour(F.max("ts")).alias("end")
    )


@query("src5_window_slots", f"""SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY slot_at) - 1 AS INTEGER) AS file_no,
  strftime(slot_at, '%Y%m%d%H%M%S') AS slot FROM (SELECT name, unnest(generate_series(lo, hi, INTERVAL 6 HOUR)) AS slot_at FROM ({WINDOWS_SQL}))""")
def _(t):
    return slot_lists.window_slots(window_table(t))


def doc_articles(t):
    return t.documents.select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("url"),
        "source", F.col("text").alias("body"), (F.col("n_chars") / 8).alias("gdelt_tone"),
    )


DOC_ARTICLES = "SELECT doc_id AS seq, 'http://x/' || doc_id AS url, source, md5(text) AS digest, n_chars / 8.0::DOUBLE AS gdelt_tone FROM documents"


def _digested(df):
    return df.select("seq", "url", "source", F.md5("body").alias("digest"), "gdelt_tone")


@query("src6_json_corpus", DOC_ARTICLES)
def _(t):
    path = scratch_path(t.spark, "articles_json")
    writers.write_json_arrays(doc_articles(t), path)
    return _digested(tables.read_articles_json(t.spark, path, array=True))


@query("src6_json_lines", DOC_ARTICLES)
def _(t):
    path = scratch_path(t.spark, "articles_json")
    writers.write_articles(doc_articles(t), path, "json")
    return _digested(tables.read_articles_json(t.spark, path))


# One feed answer per page, listing the page and a copy of it.

def answers_a(t):
    item = lambda url: F.struct(
        url.alias("url"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("domain"), F.lit("20240105T101500Z").alias("seendate"),
    )
    listed = F.to_json(F.struct(F.array(item(F.col("url")), item(F.concat("url", F.lit("/amp")))).alias("articles")))
    return t.pages.select("page_id", F.when(F.col("page_id") % 10 == 9, '{"status": "none"}').otherwise(listed).alias("body"))


def answers_b(t):
    name = F.when(F.col("page_id") % 4 == 1, None).otherwise(F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    source = F.when(F.col("page_id") % 4 != 2, F.struct(name.alias("name")))
    item = F.struct(
        F.when(F.col("page_id") % 9 != 4, F.col("url")).alias("url"),
        F.concat(F.lit("Story "), F.col("page_id").cast("string")).alias("title"),
        F.lit("2024-01-05T10:15:00Z").alias("publishedAt"), source.alias("source"),
    )
    return t.pages.select("page_id", F.to_json(F.struct(F.array(item).alias("articles"))).alias("body"))


LISTED_A = """(SELECT page_id, CAST(i AS INTEGER) AS pos, CASE i WHEN 0 THEN url ELSE url || '/amp' END AS url, 'Page ' || page_id AS title,
  regexp_extract(url, '^https?://([^/?#]+)', 1) AS domain, '20240105T101500Z' AS seendate FROM pages, range(2) r(i) WHERE page_id % 10 <> 9)"""
LISTED_B = """(SELECT page_id, CAST(0 AS INTEGER) AS pos, CASE WHEN page_id % 9 <> 4 THEN url END AS url, 'Story ' || page_id AS title,
  '2024-01-05T10:15:00Z' AS publishedAt, CASE WHEN page_id % 4 = 2 THEN 'Unknown' WHEN page_id % 4 = 1 THEN NULL
    ELSE regexp_extract(url, '^https?://([^/?#]+)', 1) END AS source FROM pages)"""


@query("src7_feed_a_articles", f"SELECT * FROM {LISTED_A}")
def _(t):
    return feeds.feed_a_articles(answers_a(t))


@query("src8_feed_b_articles", f"SELECT page_id, pos, url, title, publishedAt, source FROM {LISTED_B}")
def _(t):
    rows = feeds.feed_b_articles(answers_b(t))
    return rows.withColumn("source", feeds.publisher_name(F.col("source")))


@query("src9_table_scan", "SELECT * FROM customer")
def _(t):
    name = f"scan_{uuid.uuid4().hex[:12]}"
    writers.replace_table(t.customer, name, scratch_path(t.spark, "customer"))
    return tables.read_table(t.spark, name)


def page_text_sql(c: str = "html") -> str:
    """The main text, the same way: elements out, article or main or all, blocks that are not mostly links."""
    c = S.gsub(c, COMMENT, " ")
    for name in pages.SKIPPED:
        c = S.gsub(c, element_pattern(name), " ")
    plain = lambda b: f"length(trim({S.gsub(b, TAG, ' ')}))"
    inside = [f"regexp_extract_all(rest, {quoted(pages.inside_pattern(name))}, 1)" for name in pages.MAIN]
    region = "rest"
    for found in reversed(inside):
        region = f"CASE WHEN len({found}) > 0 THEN array_to_string({found}, ' ') ELSE {region} END"
    blocks = f"string_split({S.gsub(region, pages.BLOCK, chr(1))}, chr(1))"
    kept = f"list_filter({blocks}, lambda b: 2 * {plain(S.gsub('b', pages.LINK, ' '))} >= {plain('b')})"
    main = f"list_transform([{c}], lambda rest: CASE WHEN rest IS NOT NULL THEN coalesce(array_to_string({kept}, ' '), '') END)[1]"
    return f"trim({S.gsub(S.unescape(S.gsub(main, TAG, ' ')), '[' + SPACES + ']+', ' ')})"


TITLE = f"trim({S.gsub(S.unescape('regexp_extract(html, ' + quoted(pages.TITLE) + ', 1)'), '[' + SPACES + ']+', ' ')})"


@query("src11_page_extract", f"SELECT page_id, {TITLE} AS headline, md5(body) AS digest FROM (SELECT *, {page_text_sql()} AS body FROM pages) WHERE length(body) > 100")
def _(t):
    scraped = pages.scrape(t.pages).filter(pages.long_enough(F.col("body")))
    return scraped.select("page_id", "headline", F.md5("body").alias("digest"))


BUILT = """SELECT page_id, CASE page_id % 6
  WHEN 0 THEN replace(replace(html, '<article>', '<header><h2>Site name</h2></header><main id="m">'), '</article>', '</main><aside><p>Read this too</p></aside>')
  WHEN 1 THEN replace(replace(html, '<article>', '<form action="/s"><label>Search all pages</label></form><div>'), '</article>', '</div><FOOTER class="x">All rights</FOOTER>')
  WHEN 2 THEN replace(html, '</article>', '<ul><li><a href="/1">More on this</a> now</li><li><a href="/2">And</a> that is quite something else</li></ul></article><article>second part</article>')
  WHEN 3 THEN replace(replace(html, '<article>', ''), '</article>', '<p><a href="/x">one link</a><a href="/y">and another</p>')
  WHEN 4 THEN replace(html, '</article>', '') ELSE html END AS html FROM {pages}"""


@query("src11_main_text", f"SELECT page_id, coalesce({page_text_sql()}, '') AS body FROM ({plain(BUILT)})")
def _(t):
    """Pages with headers, footers, asides, forms, lists of links, several articles, or none."""
    return t.sql(BUILT, "pages").select("page_id", pages.page_text(F.col("html")).alias("body"))


@query("src12_page_text", f"""SELECT page_id, md5(coalesce(CASE WHEN page_id % 5 <> 2 THEN {page_text_sql()} END, '')) AS digest FROM pages""")
def _(t):
    html = F.when(F.col("page_id") % 5 != 2, F.col("html"))
    return t.pages.select("page_id", F.md5(pages.page_text(html)).alias("digest"))


# --- projections, scalars and filters on feed lines ----------------------------------------------


@query("prj1_feed_article", f"SELECT line_no, {ARTICLE_FIELDS}, {TONE} AS gdelt_tone, '2024-06-01T12:00:00.000000Z' AS scrape_at FROM ({PARSED})")
def _(t):
    return gkg.to_articles(parsed_feed(t), "line_no", scraped_at=stamp())


@query("prj2_feed_article_without_tone", f"SELECT line_no, {ARTICLE_FIELDS} FROM ({PARSED})")
def _(t):
    return gkg.to_articles(parsed_feed(t), "line_no", with_tone=False).drop("scrape_at")


@query("prj3_feed_a_record", f"""SELECT page_id, pos, url, domain AS source, title AS headline, seendate AS published_at,
  '2024-06-01T12:00:00.000000' AS scrape_at FROM {LISTED_A}""")
def _(t):
    return feeds.feed_a_records(feeds.feed_a_articles(answers_a(t)), "page_id", "pos", scraped_at=stamp())


@query("prj4_feed_b_record", f"""SELECT page_id, url, source, title AS headline, publishedAt AS published_at FROM {LISTED_B}""")
def _(t):
    return feeds.feed_b_records(feeds.feed_b_articles(answers_b(t)), "page_id").drop("scrape_at")


@query("prj6_existing_columns", f"SELECT url, published_at, topic, sentiment_score FROM {SCORED}")
def _(t):
    from tidewire.operators.aggregates import scored_rows

    return writers.existing_columns(scored_rows(articles(t)))


@query("prj8_ingest_stamp", f"SELECT line_no, true AS well_formed, true AS recent FROM ({PARSED})")
def _(t):
    """The stamp differs from run to run: its form and its distance from now are checked."""
    stamped = gkg.to_articles(parsed_feed(t), "line_no").select("line_no", "scrape_at")
    away = F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.col("scrape_at").try_cast("timestamp")))
    form = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"
    return stamped.select("line_no", F.col("scrape_at").rlike(form).alias("well_formed"), (away < 3600).alias("recent"))


@query("scl3_feed_date", f"""SELECT line_no, CASE WHEN try_strptime(left(date, 8), '%Y%m%d') IS NOT NULL
  THEN strftime(try_strptime(left(date, 8), '%Y%m%d'), '%Y-%m-%dT%H:%M:%SZ') END AS published_at FROM ({PARSED})""")
def _(t):
    return parsed_feed(t).select("line_no", dates.gkg_date(F.col("date")).alias("published_at"))


@query("scl4_parse_tone", f"SELECT line_no, {TONE} AS tone FROM ({PARSED})")
def _(t):
    return parsed_feed(t).select("line_no", fields.parse_tone(F.col("tone_csv")).alias("tone"))


@query("scl5_strip_stringify", f"SELECT line_no, trim(coalesce(source, 'nan')) AS source, trim(coalesce(url, 'nan')) AS url, coalesce(themes, 'nan') AS themes FROM ({PARSED})")
def _(t):
    return parsed_feed(t).select(
        "line_no", fields.strip_stringify(F.col("source")).alias("source"), fields.strip_stringify(F.col("url")).alias("url"),
        fields.stringify(F.col("themes")).alias("themes"),
    )


@query("scl33_publisher_name", f"SELECT page_id, source FROM {LISTED_B}")
def _(t):
    rows = feeds.feed_b_articles(answers_b(t))
    return rows.select("page_id", feeds.publisher_name(F.col("source")).alias("source"))


@query("flt1_bulk_keywords", f"SELECT line_no, url, themes FROM ({PARSED}) WHERE {BULK}")
def _(t):
    return parsed_feed(t).filter(filters.mentions_joined(F.col("themes"), F.col("url"))).select("line_no", "url", "themes")


@query("flt2_historical_keywords", f"SELECT line_no, url, themes FROM ({PARSED}) WHERE {HISTORICAL}")
def _(t):
    return parsed_feed(t).filter(filters.mentions_either(F.col("themes"), F.col("url"))).select("line_no", "url", "themes")


@query("flt3_url_present", f"SELECT line_no, url FROM ({PARSED}) WHERE url IS NOT NULL")
def _(t):
    return parsed_feed(t).filter(F.col("url").isNotNull()).select("line_no", "url")


@query("flt4_web_url", f"SELECT line_no, url FROM ({PARSED}) WHERE {WEB}")
def _(t):
    return parsed_feed(t).filter(filters.is_web_url(F.col("url"))).select("line_no", "url")


@query("udf1_relevance_flag", f"SELECT line_no, {BULK} AS relevant FROM ({PARSED})")
def _(t):
    return parsed_feed(t).select("line_no", filters.mentions_joined(F.col("themes"), F.col("url")).alias("relevant"))


OWN = keyword_sql("lower(coalesce(themes, 'nan'))", ["sport", "music"])


@query("udf3_own_keywords", f"SELECT line_no FROM ({PARSED}) WHERE {OWN}")
def _(t):
    own = ["sport", "music"]
    return parsed_feed(t).filter(filters.mentions_either(F.col("themes"), F.lit(""), own)).select("line_no")


# --- quotas, merges ------------------------------------------------------------------------------

RELEVANT = f"(SELECT line_no, file_no, {ARTICLE_FIELDS}, {TONE} AS gdelt_tone FROM ({PARSED}) WHERE {WEB} AND {BULK})"
FIRST = f"(SELECT * FROM {RELEVANT} QUALIFY row_number() OVER (PARTITION BY url ORDER BY file_no, line_no) = 1)"
PER_FILE = f"(SELECT i AS file_no, count(url) AS n FROM range(96) r(i) LEFT JOIN {FIRST} f ON f.file_no = i GROUP BY i)"
TRIED = f"(SELECT * FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS collected_before FROM {PER_FILE}) WHERE collected_before < 60)"


def first_relevant(t):
    rows = parsed_feed(t).filter(
        filters.is_web_url(F.col("url")) & filters.mentions_joined(F.col("themes"), F.col("url"))
    )
    return dedup.keep_first(gkg.to_articles(rows, "file_no", "line_no"), "url", "file_no", "line_no")


@query("win2_file_quota", f"SELECT file_no, n, CAST(collected_before AS BIGINT) AS collected_before FROM {TRIED}")
def _(t):
    return quota.quota_by_file(first_relevant(t), slots(t), 60)[1].select("file_no", "n", "collected_before")


@query("lim2_target_stop", f"SELECT url, file_no FROM {FIRST} WHERE file_no IN (SELECT file_no FROM {TRIED})")
def _(t):
    return quota.quota_by_file(first_relevant(t), slots(t), 60)[0].select("url", "file_no")


@query("lim2_bulk_target", f"""SELECT url, source, headline, published_at, body, gdelt_tone, themes, file_no, line_no FROM {FIRST}
  WHERE file_no IN (SELECT file_no FROM {TRIED})""")
def _(t):
    lines = parsed_feed(t).withColumnRenamed("file_no", "slot")
    return collect.collect_bulk(lines, slots(t), target=60)[0].drop("scrape_at")


@query("lim2_landed_target", f"""SELECT url, source, headline, published_at, body, gdelt_tone, themes, file_no FROM {FIRST}
  WHERE file_no IN (SELECT file_no FROM {TRIED})""")
def _(t):
    found, _ = collect.collect_landed(t.spark, landed_in_order(t), named_slots(t), target=60, layout=LAYOUT, first_group=16)
    return found.drop("scrape_at", "line_no")


@query("lim2_target_counters", f"SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS files_tried FROM {TRIED}")
def _(t):
    lines = parsed_feed(t).withColumnRenamed("file_no", "slot")
    return collect.collect_bulk(lines, slots(t), target=60)[1]


@query("stg1_collect_bulk", f"SELECT url, source, headline, published_at, body, gdelt_tone, themes, file_no, line_no FROM {FIRST}")
def _(t):
    """Over all slots, as ``run_stages`` does without a target."""
    lines = parsed_feed(t).withColumnRenamed("file_no", "slot")
    return collect.collect_bulk(lines, slots(t), target=collect.MANY)[0].drop("scrape_at")


@query("stg1_collect_landed", f"SELECT url, source, headline, published_at, body, gdelt_tone, themes, file_no FROM {FIRST}")
def _(t):
    found, _ = collect.collect_landed(t.spark, landed_in_order(t), named_slots(t), target=None, layout=LAYOUT)
    return found.drop("scrape_at", "line_no")


@query("agg6_collection_counters", f"SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS files_tried FROM {PER_FILE}")
def _(t):
    lines = parsed_feed(t).withColumnRenamed("file_no", "slot")
    return collect.collect_bulk(lines, slots(t), target=collect.MANY)[1]


# Three windows of 32 slots each, settled in order with a quota of 25.
STORED = "(SELECT url FROM pages WHERE contains(url, '/es/'))"


def _window_cte(k: int, place: int) -> str:
    """The window of slots from 32 * ``place`` on, settled as number ``k``."""
    seen = f"SELECT url FROM {STORED}" + "".join(f" UNION ALL SELECT url FROM took{j}" for j in range(k))
    return f"""seen{k} AS MATERIALIZED ({seen}),
  fresh{k} AS MATERIALIZED (SELECT * FROM hist WHERE file_no // 32 = {place} AND url NOT IN (SELECT url FROM seen{k})
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY file_no, line_no) = 1),
  files{k} AS (SELECT i AS file_no, count(url) AS n FROM range({32 * place}, {32 * place + 32}) r(i) LEFT JOIN fresh{k} f ON f.file_no = i GROUP BY i),
  took{k} AS MATERIALIZED (SELECT * FROM fresh{k} WHERE file_no IN (SELECT file_no FROM (
    SELECT file_no, coalesce(sum(n) OVER (ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM files{k}) WHERE before < 25))"""


def _settled(*places: int) -> str:
    """CTEs of three windows settled in this order."""
    return f"""WITH hist AS MATERIALIZED (SELECT line_no, file_no, {ARTICLE_FIELDS} FROM ({PARSED}) WHERE {WEB} AND {HISTORICAL}),
  {", ".join(_window_cte(k, place) for k, place in enumerate(places))}"""


STG2 = _settled(0, 1, 2)


def window_run(t, stored=None):
    lists = slots(t).withColumns({
        "name": F.concat(F.lit("w"), F.floor(F.col("file_no") / 32).cast("string")), "slot": F.format_string("%03d", "slot"),
    })
    lines = parsed_feed(t).withColumn("slot", F.format_string("%03d", "file_no")).drop("file_no")
    known = t.pages.filter(F.contains("url", F.lit("/es/"))).select("url") if stored is None else stored
    return collect.collect_windows(lines, lists, known, target_total=75)


@query("stg2_collect_windows", f"""{STG2}
  SELECT * FROM (SELECT *, 'w0' AS "window" FROM took0 UNION ALL SELECT *, 'w1' FROM took1 UNION ALL SELECT *, 'w2' FROM took2)""")
def _(t):
    return window_run(t).drop("scrape_at")


@query("lim3_window_quota", f"""{STG2} SELECT 'w0' AS "window", count(*) AS n FROM took0 UNION ALL SELECT 'w1', count(*) FROM took1
  UNION ALL SELECT 'w2', count(*) FROM took2""")
def _(t):
    names = slots(t).select(F.concat(F.lit("w"), F.floor(F.col("file_no") / 32).cast("string")).alias("window")).distinct()
    counts = window_run(t).groupBy("window").agg(F.count("*").alias("n"))
    return names.join(counts, "window", "left").na.fill(0, ["n"])


@query("stg2_landed_windows", f"""{_settled(1, 2, 0)} SELECT * EXCLUDE (line_no) FROM (SELECT *, 'w1' AS "window" FROM took0
  UNION ALL SELECT *, 'w2' FROM took1 UNION ALL SELECT *, 'w0' FROM took2)""")
def _(t):
    """From landed files, the windows in an order of their own: which one keeps a shared URL depends on it."""
    place = F.floor(F.col("file_no") / 32).cast("int")
    lists = named_slots(t).withColumns({"name": F.concat(F.lit("w"), place.cast("string")), "window_no": (place + 2) % 3})
    known = t.pages.filter(F.contains("url", F.lit("/es/"))).select("url")
    found = collect.collect_landed_windows(t.spark, landed_in_order(t), lists, known, target_total=75, layout=LAYOUT)
    return found.drop("scrape_at", "line_no")


def resumed(t):
    """Three runs over the same slots: one that is cut off, one that goes on, one that finds nothing to do."""
    root, urls = landed_in_order(t), store.UrlStore(t.spark, scratch_path(t.spark, "store"), shards=16)
    lists, runs = named_slots(t), []

    def go(**limits):
        collect.collect_resumable(t.spark, root, lists, urls, layout=LAYOUT, slots_per_batch=20, scraped_at=stamp(), **limits)
        runs.append((urls.finished().count(), urls.read(COLLECTED).count()))

    go(max_batches=2)
    # Cut off while it writes the third batch: some of its articles are there, its slots are not recorded.
    lines = gkg.read_slots(t.spark, root, lists.filter("file_no = 41"), LAYOUT)
    urls.append(collect.relevant_articles(lines, lists, defaults.BULK_KEYWORDS, stamp()), 2)
    go()
    go()
    return urls, runs


COLLECTED = "file_no long, line_no long, url string, source string, headline string, published_at string, scrape_at string, body string, gdelt_tone double, themes string"


@query("snk5_resumed_store", f"SELECT url, source, published_at, gdelt_tone, themes, file_no, file_no // 20 AS batch FROM {FIRST}")
def _(t):
    return resumed(t)[0].read(COLLECTED).select("url", "source", "published_at", "gdelt_tone", "themes", "file_no", "batch")


@query("snk5_resume_adds_nothing", f"""SELECT 1::BIGINT AS run, 40::BIGINT AS slots, count(*) AS articles FROM {FIRST} WHERE file_no < 40
  UNION ALL SELECT unnest([2, 3])::BIGINT, 96, (SELECT count(*) FROM {FIRST})""")
def _(t):
    return t.spark.createDataFrame([(i + 1, *r) for i, r in enumerate(resumed(t)[1])], "run long, slots long, articles long")


@query("join3_not_stored", f"SELECT page_id, url FROM {LISTED_A} WHERE url NOT IN (SELECT url FROM {STORED})")
def _(t):
    listed = feeds.feed_a_articles(answers_a(t)).select("page_id", "url")
    return dedup.not_stored(listed, t.pages.filter(F.contains("url", F.lit("/es/"))))


@query("lim1_first_articles", "SELECT page_id, url FROM pages QUALIFY row_number() OVER (ORDER BY page_id) <= (SELECT count(*) // 2 FROM pages)")
def _(t):
    """The first half of the table: too many for one task to sort."""
    return quota.first_rows(t.pages.select("page_id", "url"), "page_id", t.pages.count() // 2)


CAPS = {"a": 250, "b": 10}
BOTH = f"""(SELECT 'a' AS feed, 2 * page_id + pos AS seq, url, domain AS source, title AS headline FROM {LISTED_A}
  UNION ALL SELECT 'b', page_id, url, source, title FROM {LISTED_B})"""


@query("lim5_feed_caps", f"SELECT feed, seq, url FROM {BOTH} QUALIFY row_number() OVER (PARTITION BY feed ORDER BY seq) <= CASE feed WHEN 'a' THEN 250 ELSE 10 END")
def _(t):
    a = feeds.feed_a_articles(answers_a(t)).select(F.lit("a").alias("feed"), (2 * F.col("page_id") + F.col("pos")).alias("seq"), "url")
    b = feeds.feed_b_articles(answers_b(t)).select(F.lit("b").alias("feed"), F.col("page_id").alias("seq"), "url")
    return merge.cap_per_feed(a.unionByName(b), CAPS)


@query("set1_concatenate", f"SELECT line_no, url FROM ({PARSED}) WHERE {HISTORICAL}")
def _(t):
    rows = parsed_feed(t).filter(filters.mentions_either(F.col("themes"), F.col("url")))
    early, late = rows.filter("file_no < 48"), rows.filter("file_no >= 48")
    return early.unionByName(late).select("line_no", "url")


MERGED = f"""(SELECT url, source, headline FROM (SELECT * FROM {BOTH} QUALIFY row_number() OVER (PARTITION BY url ORDER BY feed, seq) = 1)
  WHERE url IS NULL OR url NOT IN (SELECT url FROM {STORED}))"""


@query("set2_merge_feeds", f"SELECT url, source, headline FROM {MERGED} UNION ALL SELECT url, NULL, NULL FROM {STORED}")
def _(t):
    a = feeds.feed_a_articles(answers_a(t)).withColumn("seq", 2 * F.col("page_id") + F.col("pos"))
    b = feeds.feed_b_articles(answers_b(t)).withColumn("seq", F.col("page_id"))
    stored = t.pages.filter(F.contains("url", F.lit("/es/"))).select("url")
    merged = merge.merge_feeds(stored, feeds.feed_a_records(a, "seq"), feeds.feed_b_records(b, "seq"))
    return merged.select("url", "source", "headline")


@query("lim1_scraped_first", f"""SELECT seq, headline, md5(body) AS digest FROM (
  SELECT l.page_id AS seq, {TITLE} AS headline, {page_text_sql()} AS body FROM (SELECT * FROM pages ORDER BY page_id LIMIT 200) l) WHERE length(body) > 100""")
def _(t):
    first_of = dedup.keep_first(t.pages, "url", "page_id")
    listed = t.pages.select(F.col("page_id").alias("seq"), "url")
    found, _ = collect.scrape_bodies(listed, first_of, max_articles=200)
    return found.select("seq", "headline", F.md5("body").alias("digest"))


@query("agg6_scrape_counters", f"""SELECT count(CASE WHEN length(coalesce(body, '')) > 100 THEN 1 END) AS scraped,
  count(*) - count(CASE WHEN length(coalesce(body, '')) > 100 THEN 1 END) AS failed FROM (SELECT {page_text_sql()} AS body FROM pages WHERE page_id % 3 <> 1
  UNION ALL SELECT '' FROM pages WHERE page_id % 3 = 1)""")
def _(t):
    """Counted while the bodies are written; a third of the articles has no page."""
    listed = t.pages.select(F.col("page_id").alias("seq"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"))
    landed_pages = t.pages.filter("page_id % 3 <> 1").select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), "html")
    path = scratch_path(t.spark, "bodies")
    keep = lambda rows: writers.write_articles(rows.filter(pages.long_enough(F.col("body"))), path)
    seen = writers.write_counted(collect.scraped_pages(listed, landed_pages), keep, **collect.scrape_counters())
    assert t.spark.read.parquet(path).count() == seen["scraped"]
    return t.spark.createDataFrame([(seen["scraped"], seen["failed"])], "scraped long, failed long")


CAPPED = f"""(SELECT * FROM {BOTH} QUALIFY row_number() OVER (PARTITION BY feed ORDER BY seq) <= CASE feed WHEN 'a' THEN 250 ELSE 10 END)"""
STG4 = f"""SELECT n.url, n.source, n.headline, md5(coalesce({page_text_sql('p.html')}, '')) AS digest
  FROM (SELECT * FROM {CAPPED} QUALIFY row_number() OVER (PARTITION BY url ORDER BY feed, seq) = 1) n
  LEFT JOIN (SELECT url, html FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1) p ON p.url = n.url
  WHERE n.url IS NULL OR n.url NOT IN (SELECT url FROM {STORED})
  UNION ALL SELECT url, NULL, NULL, NULL FROM {STORED}"""


@query("lim5_collected_with_caps", STG4)
def _(t):
    a = feeds.feed_a_articles(answers_a(t)).withColumn("seq", 2 * F.col("page_id") + F.col("pos"))
    b = feeds.feed_b_articles(answers_b(t)).withColumn("seq", F.col("page_id"))
    stored = t.pages.filter(F.contains("url", F.lit("/es/"))).select("url")
    merged = collect.collect_feeds(stored, a, b, dedup.keep_first(t.pages, "url", "page_id"), caps=CAPS, scraped_at=stamp())
    return merged.select("url", "source", "headline", F.md5("body").alias("digest"))


@query("stg3_scrape_bodies", f"""SELECT seq, headline, md5(body) AS digest FROM (
  SELECT page_id AS seq, {TITLE} AS headline, {page_text_sql()} AS body FROM pages) WHERE length(body) > 100""")
def _(t):
    listed = t.pages.select(F.col("page_id").alias("seq"), "url")
    found, _ = collect.scrape_bodies(listed, dedup.keep_first(t.pages, "url", "page_id"), max_articles=None)
    return found.select("seq", "headline", F.md5("body").alias("digest"))


def _collected(listed: str) -> str:
    return f"""SELECT n.url, n.source, n.headline, md5(coalesce({page_text_sql('p.html')}, '')) AS digest
  FROM (SELECT * FROM {listed} QUALIFY row_number() OVER (PARTITION BY url ORDER BY feed, seq) = 1) n
  LEFT JOIN (SELECT url, html FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1) p ON p.url = n.url
  WHERE n.url IS NULL OR n.url NOT IN (SELECT url FROM {STORED})
  UNION ALL SELECT url, NULL, NULL, NULL FROM {STORED}"""


def feeds_collected(t, **caps):
    a = feeds.feed_a_articles(answers_a(t)).withColumn("seq", 2 * F.col("page_id") + F.col("pos"))
    b = feeds.feed_b_articles(answers_b(t)).withColumn("seq", F.col("page_id"))
    stored = t.pages.filter(F.contains("url", F.lit("/es/"))).select("url")
    merged = collect.collect_feeds(stored, a, b, dedup.keep_first(t.pages, "url", "page_id"), scraped_at=stamp(), **caps)
    return merged.select("url", "source", "headline", F.md5("body").alias("digest"))


@query("stg4_collect_feeds", _collected(BOTH))
def _(t):
    return feeds_collected(t)


@query("lim5_caps_per_answer", _collected(f"""(SELECT * FROM {BOTH}
  QUALIFY row_number() OVER (PARTITION BY feed, CASE feed WHEN 'a' THEN seq // 2 ELSE seq END ORDER BY seq) <= 1)"""))
def _(t):
    return feeds_collected(t, caps={"a": 1, "b": 1}, answer="page_id")


# --- sinks and the stages that end in them -------------------------------------------------------


@query("snk1_article_files", DOC_ARTICLES)
def _(t):
    path = scratch_path(t.spark, "articles")
    writers.write_articles(doc_articles(t), path)
    return _digested(t.spark.read.parquet(path))


DAILY_ROWS = f"""SELECT topic, CAST(published_date AS VARCHAR) AS published_date, round(avg_sentiment, 6) AS avg_sentiment,
  round(sentiment_std, 6) AS sentiment_std, article_count FROM {DAILY}"""


@query("snk2_replace_table", DAILY_ROWS)
def _(t):
    from tidewire.plans.export import analysis_tables

    daily = analysis_tables(articles(t), anchors(t))["daily_sentiment_aggregation"]
    name, path = f"daily_{uuid.uuid4().hex[:12]}", scratch_path(t.spark, "daily")
    for _round in range(2):
        writers.replace_table(daily, name, path)
    return rounded(tables.read_table(t.spark, name), "avg_sentiment", "sentiment_std")


@query("snk2_dated_table", f"""SELECT topic, published_date, CASE WHEN dayofmonth(published_date) % 3 = 0 THEN round(avg_sentiment, 6) ELSE -1.0 END AS avg_sentiment, article_count FROM {DAILY}""")
def _(t):
    """All days are written, then some of them again: those are replaced, the others stay as they were."""
    path = scratch_path(t.spark, "dated")
    daily = aggregates.daily_sentiment(articles(t)).drop("sentiment_std")
    writers.write_dated(daily.withColumn("avg_sentiment", F.lit(-1.0)), path)
    writers.write_dated(daily.filter(F.dayofmonth("published_date") % 3 == 0), path)
    return rounded(t.spark.read.parquet(path), "avg_sentiment").select("topic", "published_date", "avg_sentiment", "article_count")


@query("snk3_csv_export", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def _(t):
    path = scratch_path(t.spark, "csv")
    writers.write_csv(t.conversations, path)
    back = t.spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(t.conversations.schema).csv(path)
    return back.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def exported(t):
    """Run the export stage into tables of a fresh database name space."""
    from tidewire.plans.export import analysis_tables, export_tables, instant_analysis

    database = f"news_{uuid.uuid4().hex[:12]}"
    folder = scratch_path(t.spark, "tables")
    t.spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}-db'")
    export_tables(analysis_tables(articles(t), anchors(t)), database, folder)
    second = instant_analysis(t.spark.table(f"{database}.articles"), t.spark.table(f"{database}.events"))
    export_tables({"event_analysis": second}, database, folder)
    return database


STG9 = STUDENT_P.replace("s.published_at >=", "s.topic IS NOT NULL AND s.published_at >=")


INSTANT_ROWS = f"""SELECT event_name, event_date, round_even(m1, 4) AS before_mean, round_even(m2, 4) AS after_mean,
  n1 AS before_count, n2 AS after_count, CASE WHEN t <> 0 THEN round_even(t, 4) END AS t_statistic,
  CASE WHEN p <> 0 THEN round_even(p, 4) END AS p_value, coalesce(p < 0.05 AND p <> 0, FALSE) AS significant FROM {STG9}"""


@query("stg9_instant_analysis", INSTANT_ROWS)
def _(t):
    return t.spark.table(f"{exported(t)}.event_analysis")


@query("stg9_article_table", f"SELECT event_id, url, topic, sentiment_score, published_at FROM {SCORED}")
def _(t):
    """All rows of the exported articles that the second study reads."""
    rows = aggregates.scored_rows(articles(t))
    path = scratch_path(t.spark, "dated_articles")
    writers.write_dated(rows, path)
    return t.spark.read.parquet(path).select("event_id", "url", "topic", "sentiment_score", "published_at")


def exported_csv(t, name: str):
    from tidewire.plans.export import export_csv

    database, folder = exported(t), scratch_path(t.spark, "export")
    export_csv(t.spark, folder, [name], database=database)
    return t.spark.read.options(**writers.CSV_OPTIONS).schema(t.spark.table(f"{database}.{name}").schema).csv(f"{folder}/{name}")


@query("stg10_csv_daily", DAILY_ROWS)
def _(t):
    return rounded(exported_csv(t, "daily_sentiment_aggregation"), "avg_sentiment", "sentiment_std")


@query("stg10_csv_event_analysis", INSTANT_ROWS)
def _(t):
    return exported_csv(t, "event_analysis")


@query("stg10_csv_articles", f"SELECT url, topic, published_at, sentiment_score FROM {SCORED}")
def _(t):
    return exported_csv(t, "articles").select("url", "topic", "published_at", "sentiment_score")


@query("stg10_csv_copies", f"""SELECT 'articles' AS name, count(*) AS n FROM {SCORED} UNION ALL
  SELECT 'daily_sentiment_aggregation', count(*) FROM {DAILY} UNION ALL SELECT 'events', 3 UNION ALL SELECT 'event_analysis', 3""")
def _(t):
    from tidewire.plans.export import TABLES, export_csv

    database, folder = exported(t), scratch_path(t.spark, "export")
    export_csv(t.spark, folder, database=database)
    counts = [
        t.spark.read.option("header", True).csv(f"{folder}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n"))
        for n in TABLES
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


NEW_URLS = f"SELECT DISTINCT trim(url) AS url FROM ({PARSED}) WHERE {WEB} AND {HISTORICAL}"


@query("str1_incremental_ingest", NEW_URLS)
def _(t):
    from tidewire.streaming.ingest import ingest_stream, ingested

    src, dst, ckpt = (scratch_path(t.spark, n) for n in ("in", "out", "ckpt"))
    lines = feed_lines(t).select("value", "file_no")
    for part in ("file_no < 50", "file_no >= 50"):
        lines.filter(part).select("value").write.mode("append").text(src)
        ingest_stream(t.spark, src, dst, ckpt, scraped_at=stamp(), shards=16).awaitTermination()
    return ingested(t.spark, dst, shards=16).select("url")


@query("str1_zipped_ingest", NEW_URLS)
def _(t):
    from tidewire.streaming.ingest import ingest_stream, ingested

    src, dst, ckpt = (scratch_path(t.spark, n) for n in ("zips", "out", "ckpt"))
    for part in ("archive % 2 = 0", "archive % 2 = 1"):
        landed_archives(t, part, src)
        ingest_stream(t.spark, src, dst, ckpt, scraped_at=stamp(), zipped=True, shards=16).awaitTermination()
    return ingested(t.spark, dst, shards=16).select("url")


# From landed files to the daily table. All articles are one topic, and scored by the share of vowels of their bodies.
STG11 = f"""WITH RECURSIVE collected AS MATERIALIZED (SELECT file_no::BIGINT * {1 << 40} + line_no AS seq, url, published_at FROM {FIRST}),
  found AS (SELECT seq, c.url, published_at, p.html FROM collected c
    JOIN (SELECT url, html FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1) p ON p.url = c.url),
  scraped AS MATERIALIZED (SELECT seq, url, published_at, {TITLE} AS headline, {page_text_sql()} AS body FROM found),
  passed AS MATERIALIZED (SELECT * FROM (SELECT *, {CLEAN_URL} AS clean FROM scraped WHERE length(body) > 100) WHERE clean <> ''
    QUALIFY row_number() OVER (PARTITION BY clean ORDER BY seq) = 1),
  {greedy_sql('seq', band_sql('seq', '(SELECT seq, body AS text FROM passed)'))},
  cleaned AS MATERIALIZED (SELECT seq, published_at, headline, body, {S.clean_text('body')} AS cleaned FROM passed JOIN kept ON kept.id = passed.seq),
  judged AS (SELECT *, CASE WHEN trim(cleaned) = '' OR regexp_matches(s, '^[0-9]') THEN 0.0 WHEN share < 0.3 THEN -share WHEN share > 0.4 THEN share ELSE 0.0 END AS model
    FROM (SELECT *, substr(body, 1, 2000) AS s FROM cleaned), LATERAL (SELECT ({VOWELS})::DOUBLE / length(s) AS share)),
  terms AS MATERIALIZED (SELECT term, count(*) AS tf FROM (SELECT unnest({S.words("CASE WHEN trim(cleaned) <> '' THEN cleaned ELSE coalesce(headline, '') END")}) AS term FROM cleaned) GROUP BY term),
  named AS (SELECT 'Topic_0_' || string_agg(term, '_' ORDER BY r) AS topic FROM (
    SELECT term, row_number() OVER (ORDER BY tf * ln(1 + (SELECT sum(tf) FROM terms)::DOUBLE / tf) DESC, term) AS r FROM terms) WHERE r <= 3),
  dated AS (SELECT CASE WHEN {S.word_count('cleaned')} >= 20 AND abs(model) > 0.001 THEN model ELSE 0.0 END AS score,
    CAST(try_strptime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS DATE) AS day FROM judged)
  SELECT (SELECT topic FROM named) AS topic, CAST(day AS VARCHAR) AS published_date, round(avg(score), 6) AS avg_sentiment,
    round(coalesce(stddev_samp(score), 0), 6) AS sentiment_std, count(*) AS article_count FROM dated WHERE day IS NOT NULL GROUP BY day"""


@query("stg11_all_stages", STG11)
def _(t):
    """From the landed files of all slots to the exported daily table, each stage reading what the one before wrote."""
    from tidewire.plans.run import STAGES, run_stages

    root = scratch_path(t.spark, "run")
    database = f"run_{uuid.uuid4().hex[:12]}"
    t.spark.sql(f"CREATE DATABASE {database} LOCATION '{root}-db'")
    # Feed URLs are stripped when collected, so pages are looked up by the plain URL.
    pages_by_url = dedup.keep_first(t.pages, "url", "page_id")
    run_stages(
        t.spark, STAGES, root, landed=landed_in_order(t), layout=LAYOUT, slots=named_slots(t), pages=pages_by_url, scorer=_toy_scorer,
        lexicon={"nowhere": 1.0}, events=anchors(t), k=1, database=database,
    )
    return rounded(t.spark.table(f"{database}.daily_sentiment_aggregation"), "avg_sentiment", "sentiment_std")


@query("stg11_bundled_model")
def _(t):
    from tidewire.operators.scoring import default_scorer
    from tidewire.plans.run import STAGES, run_stages

    root = scratch_path(t.spark, "run")
    database = f"run_{uuid.uuid4().hex[:12]}"
    t.spark.sql(f"CREATE DATABASE {database} LOCATION '{root}-db'")
    lines = parsed_feed(t).withColumnRenamed("file_no", "slot")
    # Feed URLs are stripped when collected, so pages are looked up by the plain URL.
    pages_by_url = dedup.keep_first(t.pages, "url", "page_id")
    scorer = default_scorer(t.documents.join(t.labels, "doc_id"), "text", "quality")
    run_stages(
        t.spark, STAGES, root, lines=lines, slots=slots(t), pages=pages_by_url, scorer=scorer,
        events=anchors(t), k=5, database=database,
    )
    return t.spark.table(f"{database}.daily_sentiment_aggregation")
