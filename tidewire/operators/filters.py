"""Row filters of the collection, cleaning and export jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import defaults
from tidewire.functions.fields import stringify
from tidewire.functions.text import contains_any, strip


def mentions_joined(themes: Column, url: Column, keywords: Sequence[str] = defaults.BULK_KEYWORDS) -> Column:
    """Keyword in the lower-cased text ``themes + ' ' + url``."""
    text = F.lower(F.concat(stringify(themes), F.lit(" "), stringify(url)))
    return contains_any(text, keywords)


def mentions_either(themes: Column, url: Column, keywords: Sequence[str] = defaults.HISTORICAL_KEYWORDS) -> Column:
    """Keyword in lower-cased ``themes`` or in lower-cased ``url``."""
    return contains_any(F.lower(stringify(themes)), keywords) | contains_any(F.lower(stringify(url)), keywords)


def is_web_url(url: Column) -> Column:
    return url.isNotNull() & strip(url).startswith("http")


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where none of ``columns`` is NULL or NaN; the NULL part reaches the scan."""
    kinds = dict(df.dtypes)
    for name in columns:
        df = df.filter(F.col(name).isNotNull())
        if kinds[name] in ("double", "float"):
            df = df.filter(~F.isnan(name))
    return df
