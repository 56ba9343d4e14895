"""Title and readable text of raw web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.lookup import bind
from tidewire.functions.text import COMMENT, TAG, element_pattern, plain_spaces, unescape_html

MIN_BODY_CHARS = 100
TITLE = r"(?is)<title(?:[ \t\r\n][^>]*)?>(.*?)</title[ \t\r\n]*>"
# Elements whose content is no article text.
SKIPPED = ("head", "script", "style", "template", "nav", "header", "footer", "aside", "form")
# Elements that hold the article, if there are any; the first kind found counts.
MAIN = ("article", "main")
# Tags that begin or end a block of text.
BLOCK = (
    r"(?i)</?(?:p|div|li|ul|ol|dl|dt|dd|table|tr|td|th|h[1-6]|section|article|main|blockquote|pre|figure|figcaption|hr|br)"
    r"(?:[ \t\r\n/][^>]*)?>"
)
LINK = r"(?is)<a(?:[ \t\r\n/][^>]*)?>.*?(?:</a[ \t\r\n]*>|\z)"


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(plain_spaces(unescape_html(c)), " +", " "))


def page_title(html: Column) -> Column:
    return _tidy(F.regexp_replace(F.regexp_extract(html, TITLE, 1), TAG, " "))


def inside_pattern(name: str) -> str:
    """Pattern of an element with its content as the first group."""
    return rf"(?is)<{name}(?:[ \t\r\n/][^>]*)?>(.*?)(?:</{name}[ \t\r\n]*>|\z)"


def page_text(html: Column) -> Column:
    """The main text of a page; ``""`` for a missing one.

    Scripts, navigation and the like go first. Of what is left the ``article`` elements count, else ``main``, else all.
    That is cut into blocks, and those whose text is mostly links go, too.
    """
    text = F.regexp_replace(html, COMMENT, " ")
    for name in SKIPPED:
        text = F.regexp_replace(text, element_pattern(name), " ")

    def region(rest: Column) -> Column:
        out = rest
        for name in reversed(MAIN):
            found = F.regexp_extract_all(rest, F.lit(inside_pattern(name)), F.lit(1))
            out = F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(out)
        return out

    def plain(block: Column) -> Column:
        return F.trim(F.regexp_replace(block, TAG, " "))

    def mostly_text(block: Column) -> Column:
        return 2 * F.length(plain(F.regexp_replace(block, LINK, " "))) >= F.length(plain(block))

    blocks = bind(text, lambda rest: F.split(F.regexp_replace(region(rest), BLOCK, "\x01"), "\x01"))
    return F.coalesce(_tidy(F.regexp_replace(F.array_join(F.filter(blocks, mostly_text), " "), TAG, " ")), F.lit(""))


def scrape(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``headline`` and ``body``, extracted once however often they are used later."""
    found = F.struct(
        F.coalesce(page_title(F.col(html)), F.lit("")).alias("headline"), page_text(F.col(html)).alias("body")
    )
    return pages.select("*", F.inline(F.array(found)))


def long_enough(body: Column) -> Column:
    return F.length(body) > MIN_BODY_CHARS
