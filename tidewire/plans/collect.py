"""Collection jobs: bulk slots, historical windows, page bodies, two feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import defaults
from tidewire.operators.dedup import keep_first, not_stored
from tidewire.operators.filters import is_web_url, mentions_either, mentions_joined
from tidewire.operators.hotkeys import MAX_BROADCAST_ROWS, is_short, short_side
from tidewire.operators.merge import cap_per_feed, new_from_feeds
from tidewire.operators.quota import first_rows, quota_by_file
from tidewire.session import cut_lineage
from tidewire.sinks.store import UrlStore
from tidewire.sources.feeds import feed_a_records, feed_b_records
from tidewire.sources.gkg import read_slots, to_articles
from tidewire.sources.pages import long_enough, page_text, scrape

ORDER = ("file_no", "line_no")
MANY = (1 << 63) - 1


def relevant_articles(lines: DataFrame, slots: DataFrame, keywords: Sequence[str], scraped_at: Column | None) -> DataFrame:
    """The listed articles on the keywords, with ``file_no`` and ``line_no``."""
    relevant = lines.filter(is_web_url(F.col("url")) & mentions_joined(F.col("themes"), F.col("url"), keywords))
    return to_articles(relevant.join(short_side(slots), "slot"), *ORDER, scraped_at=scraped_at)


def collect_bulk(
    lines: DataFrame,
    slots: DataFrame,
    target: int = 15_000,
    keywords: Sequence[str] = defaults.BULK_KEYWORDS,
    scraped_at: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Relevant articles, each URL once, from the slots read until the target was met.

    ``lines`` are parsed feed lines with ``slot`` and ``line_no``; ``slots`` is
    (file_no, slot) in reading order. Returns the articles (with ``file_no`` and
    ``line_no``) and one row (total, files_tried).
    """
    articles = relevant_articles(lines, slots, keywords, scraped_at)
    accepted, tried = quota_by_file(keep_first(articles, "url", *ORDER), slots, target)
    counts = tried.agg(F.sum("n").alias("total"), F.count("*").alias("files_tried"))
    return accepted, counts


def collect_landed(
    spark: SparkSession,
    root: str,
    slots: DataFrame,
    target: int | None = None,
    keywords: Sequence[str] = defaults.BULK_KEYWORDS,
    layout: str = "{slot}.gkg.csv",
    first_group: int = 32,
    scraped_at: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``collect_bulk`` over the files landed below ``root``, read in groups of slots until ``target`` is met.

    Groups double in size, so files beyond the target are mostly never opened,
    and a long list takes few rounds. Without a target all listed files are one
    group. A URL belongs to the first file that lists it, as in a single read.
    """
    if target is None:
        return collect_bulk(read_slots(spark, root, slots, layout), slots, MANY, keywords, scraped_at)
    last = slots.agg(F.max("file_no")).first()[0]
    start, size = slots.agg(F.min("file_no")).first()[0], first_group
    taken, total, tried = None, 0, 0
    while last is not None and start <= last and total < target:
        group = slots.filter(F.col("file_no").between(start, start + size - 1))
        relevant = relevant_articles(read_slots(spark, root, group, layout), group, keywords, scraped_at)
        fresh = relevant if taken is None else not_stored(relevant, taken.select("url"))
        found, files = quota_by_file(keep_first(fresh, "url", *ORDER), group, target - total)
        found, files = cut_lineage(found), cut_lineage(files)
        taken = found if taken is None else taken.unionByName(found)
        read = files.agg(F.sum("n"), F.count("*")).first()
        total, tried = total + (read[0] or 0), tried + read[1]
        start, size = start + size, 2 * size
    if taken is None:
        return collect_bulk(read_slots(spark, root, slots, layout), slots, target, keywords, scraped_at)
    return taken, spark.range(1).select(F.lit(total).cast("long").alias("total"), F.lit(tried).cast("long").alias("files_tried"))


def collect_windows(
    lines: DataFrame,
    slots: DataFrame,
    stored: DataFrame,
    target_total: int = 10_000,
    keywords: Sequence[str] = defaults.HISTORICAL_KEYWORDS,
    scraped_at: Column | None = None,
) -> DataFrame:
    """New articles of each window, every window up to its own quota.

    ``slots`` is (name, file_no, slot), with the windows in the order of ``window_no`` if there is such
    a column, else of their first slot. A URL counts as seen only if its file was really read, so the
    windows are settled one after the other; each one leaves at most its quota
    plus one file. The feed lines themselves are scanned once for all windows.
    """
    order = "window_no" if "window_no" in slots.columns else "slot"
    names = [r[0] for r in slots.groupBy("name").agg(F.min(order).alias("s")).orderBy("s").select("name").collect()]
    quota = target_total // max(len(names), 1)
    relevant = lines.filter(is_web_url(F.col("url")) & mentions_either(F.col("themes"), F.col("url"), keywords))
    listed = to_articles(
        relevant.join(short_side(slots), "slot"), "name", *ORDER, scraped_at=scraped_at, with_tone=False
    )
    candidates = cut_lineage(keep_first(listed, ["name", "url"], *ORDER))
    result = None
    for name in names:
        in_window = candidates.filter(F.col("name") == name).withColumnRenamed("name", "window")
        seen = stored.select("url") if result is None else stored.select("url").unionByName(result.select("url"))
        files = slots.filter(F.col("name") == name).select("file_no", "slot")
        fresh = not_stored(in_window, seen, few_new=is_short(in_window))
        accepted = cut_lineage(quota_by_file(fresh, files, quota)[0])
        result = accepted if result is None else result.unionByName(accepted)
    return result


def collect_landed_windows(
    spark: SparkSession, root: str, slots: DataFrame, stored: DataFrame, target_total: int = 10_000,
    keywords: Sequence[str] = defaults.HISTORICAL_KEYWORDS, layout: str = "{slot}.gkg.csv", scraped_at: Column | None = None,
) -> DataFrame:
    """``collect_windows`` over the files landed below ``root``; only those of the listed slots are opened."""
    return collect_windows(read_slots(spark, root, slots, layout), slots, stored, target_total, keywords, scraped_at)


def collect_resumable(
    spark: SparkSession, root: str, slots: DataFrame, store: UrlStore, keywords: Sequence[str] = defaults.BULK_KEYWORDS,
    layout: str = "{slot}.gkg.csv", slots_per_batch: int = 1000, max_batches: int | None = None, scraped_at: Column | None = None,
) -> int:
    """Collect the listed slots that ``store`` does not record as done, batch by batch; returns how many batches it took.

    Cut off at any point, it goes on with the first slot that was not recorded when it is run again; a run over slots that are
    all done opens no file. ``slots`` is (file_no, slot), a short list. A URL belongs to the first file that lists it, as in a single read.
    """
    slots = slots.withColumn("slot", F.col("slot").cast("string"))
    done = 0
    while max_batches is None or done < max_batches:
        left = cut_lineage(slots.join(store.finished(), "slot", "left_anti").orderBy("file_no").limit(slots_per_batch))
        if left.isEmpty():
            break
        found = relevant_articles(read_slots(spark, root, left, layout), left, keywords, scraped_at)
        store.append(keep_first(found, "url", *ORDER), slots=left)
        done += 1
    return done


def pages_of(urls: DataFrame, pages: DataFrame, few: bool) -> DataFrame:
    """(url, html) of the wanted pages. Few URLs are sent to the pages, so only matches are shuffled."""
    html = pages.select("url", "html")
    return html.join(F.broadcast(urls.distinct()), "url", "left_semi") if few else html


def scrape_bodies(
    articles: DataFrame, pages: DataFrame, max_articles: int | None = 15_000, seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """Headline and body from landed pages for the first ``max_articles`` articles, or for all if it is None.

    ``articles`` has each URL once; ``pages`` is (url, html). Articles without a
    page or with a short text are left out and counted as failed.
    """
    found = scraped_pages(articles, pages, max_articles, seq)
    counts = found.agg(*[c.alias(name) for name, c in scrape_counters().items()])
    return found.filter(long_enough(F.col("body"))), counts


def scraped_pages(articles: DataFrame, pages: DataFrame, max_articles: int | None = None, seq: str = "seq") -> DataFrame:
    """The first ``max_articles`` articles with the headline and body of their page; both are empty without a page."""
    first = articles if max_articles is None else first_rows(articles, seq, max_articles)
    first = first.drop("headline", "body")
    wanted = pages_of(first.select("url"), pages, few=max_articles is not None and max_articles <= MAX_BROADCAST_ROWS)
    return scrape(first.join(wanted, "url", "left")).drop("html")


def scrape_counters() -> dict[str, Column]:
    """What is counted of ``scraped_pages``: bodies that are long enough, and the others."""
    enough = long_enough(F.col("body"))
    return {"scraped": F.count_if(enough), "failed": F.count_if(~enough)}


def collect_feeds(
    stored: DataFrame,
    feed_a: DataFrame,
    feed_b: DataFrame,
    pages: DataFrame,
    caps: Mapping[str, int] | None = None,
    scraped_at: Column | None = None,
    answer: str | None = None,
) -> DataFrame:
    """Stored articles plus the new ones of both feeds, with their bodies.

    ``feed_a`` and ``feed_b`` are listed articles with ``seq``. ``caps`` limits
    the articles taken of feed ``a`` and ``b``, in each answer if ``answer`` names
    its column; without it all landed ones are.
    """
    keep = ("seq", answer) if answer else ("seq",)
    a = feed_a_records(feed_a, *keep, scraped_at=scraped_at).withColumn("feed", F.lit("a"))
    b = feed_b_records(feed_b, *keep, scraped_at=scraped_at).withColumn("feed", F.lit("b"))
    if caps is not None:
        a, b = cap_per_feed(a, {"a": caps["a"]}, answer=answer), cap_per_feed(b, {"b": caps["b"]}, answer=answer)
    if answer:
        a, b = a.drop(answer), b.drop(answer)
    few = caps is not None and answer is None and sum(caps.values()) <= MAX_BROADCAST_ROWS
    merged = new_from_feeds(stored, a.drop("feed"), b.drop("feed"), few_new=few).drop("feed_no")
    wanted = pages_of(merged.select("url"), pages, few=few)
    bodies = wanted.select("url", page_text(F.col("html")).alias("body"))
    fresh = merged.join(bodies, "url", "left").withColumn("body", F.coalesce("body", F.lit("")))
    return stored.unionByName(fresh, allowMissingColumns=True)
