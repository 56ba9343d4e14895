"""Run chosen stages one after the other, from landed files to exported tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import defaults
from tidewire.functions.dates import DATE_FORMATS
from tidewire.plans.clean import clean_articles
from tidewire.plans.collect import collect_bulk, collect_landed, scrape_counters, scraped_pages
from tidewire.plans.export import analysis_tables, export_csv, export_tables, instant_analysis
from tidewire.plans.nlp import score_articles
from tidewire.plans.topics import model_topics
from tidewire.session import tune
from tidewire.sinks.writers import write_articles, write_counted, write_report
from tidewire.sources.pages import long_enough
from tidewire.sources.tables import define_events

MANY = (1 << 63) - 1
STAGES = ("collect", "clean", "nlp", "topic", "export")


def run_stages(
    spark: SparkSession,
    stages: Iterable[str],
    root: str,
    *,
    lines: DataFrame | None = None,
    landed: str | None = None,
    layout: str = "{slot}.gkg.csv",
    slots: DataFrame | None = None,
    pages: DataFrame | None = None,
    scorer=None,
    events: DataFrame | None = None,
    k: int | Sequence[int] = 20,
    min_topic_size: int = 2,
    outlier_quantile: float | None = None,
    target: int | None = None,
    max_articles: int | None = None,
    keywords: Sequence[str] = defaults.BULK_KEYWORDS,
    formats: Sequence[str] = DATE_FORMATS,
    lexicon: Mapping[str, float] = defaults.LEXICON,
    stopwords: Sequence[str] = defaults.STOPWORDS,
    lemmas: Mapping[str, str] = defaults.LEMMAS,
    database: str = "default",
) -> dict[str, dict]:
    """Run ``stages`` in order; each reads what the one before wrote below ``root``.

    ``root`` is a shared folder. Collection needs ``slots`` and ``pages``, and either ``landed``, the folder of the
    feed files, of which those of the listed slots are opened, or ``lines`` (parsed feed lines with ``slot`` and ``line_no``); ``target`` and
    ``max_articles`` stop it early, None takes all. The bundled ``lexicon`` is a
    starter set. Returns the counters of the stages that have some.
    """
    tune(spark)
    chosen = set(stages)
    unknown = chosen - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    at = lambda name: f"{root}/{name}"
    counters: dict[str, dict] = {}

    if "collect" in chosen:
        if landed is not None:
            urls, counts = collect_landed(spark, landed, slots, target, keywords, layout)
        else:
            urls, counts = collect_bulk(lines, slots, MANY if target is None else target, keywords)
        # The order of arrival becomes one number that later stages keep.
        seq = F.col("file_no").cast("long") * F.lit(1 << 40) + F.col("line_no")
        write_articles(urls.withColumn("seq", seq).drop("file_no", "line_no"), at("article_urls"))
        counters["collect"] = counts.first().asDict()
        found = scraped_pages(spark.read.parquet(at("article_urls")), pages, max_articles)
        # The pages are read once: what is counted passes by on its way to the files.
        keep = lambda rows: write_articles(rows.filter(long_enough(F.col("body"))), at("articles"))
        counters["scrape"] = write_counted(found, keep, **scrape_counters())
    if "clean" in chosen:
        cleaned, report = clean_articles(spark.read.parquet(at("articles")), formats)
        write_articles(cleaned, at("articles_cleaned"))
        write_report(report, at("data_quality_report"))
        counters["clean"] = report.first().asDict()
    if "nlp" in chosen:
        scored = score_articles(spark.read.parquet(at("articles_cleaned")), scorer, lexicon, stopwords, lemmas)
        write_articles(scored, at("articles_nlp"))
    if "topic" in chosen:
        write_articles(model_topics(spark.read.parquet(at("articles_nlp")), k, min_topic_size, outlier_quantile=outlier_quantile), at("articles_topic"))
    if "export" in chosen:
        articles = spark.read.parquet(at("articles_topic"))
        anchors = define_events(spark) if events is None else events
        export_tables(analysis_tables(articles, anchors), database, at("tables"))
        second = instant_analysis(spark.table(f"{database}.articles"), spark.table(f"{database}.events"))
        export_tables({"event_analysis": second}, database, at("tables"))
        export_csv(spark, at("export"), database=database)
    return counters
