"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def normalize_url(c: Column) -> Column:
    """Drop query, fragment, parameters of the last segment, and all trailing slashes.

    The scheme is lower-cased and the host left alone. A URL whose authority has
    an unpaired bracket cannot be parsed and comes back unchanged.
    """
    tidy = F.regexp_replace(F.regexp_replace(c, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    path = F.regexp_replace(F.regexp_replace(tidy, r"(?s)[?#].*\z", ""), r";[^/]*\z", "")
    scheme = F.regexp_extract(path, SCHEME, 1)
    lowered = F.concat(F.lower(scheme), F.substr(path, F.length(scheme) + F.lit(1)))
    host = F.regexp_extract(tidy, AUTHORITY, 1)
    unpaired = F.contains(host, F.lit("[")) != F.contains(host, F.lit("]"))
    return F.when(unpaired, c).otherwise(F.regexp_replace(lowered, r"/+\z", ""))
