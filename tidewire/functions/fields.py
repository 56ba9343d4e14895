"""Expressions over single feed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import defaults
from tidewire.functions.text import strip

_NUMBER = r"^[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*$"


def or_missing(c: Column) -> Column:
    """NULL for the texts that mean a missing field."""
    return F.when(~c.isin(defaults.MISSING_TOKENS), c)


def stringify(c: Column) -> Column:
    """A missing value becomes the word ``nan``."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def strip_stringify(c: Column) -> Column:
    return strip(stringify(c))


def parse_tone(c: Column) -> Column:
    """First comma field as a number: NaN when the field is missing, 0 when it is no number."""
    first = F.split_part(c, F.lit(","), F.lit(1))
    bare = F.lower(F.trim(first))
    return (
        F.when(c.isNull() | bare.isin("nan", "+nan", "-nan"), F.lit(float("nan")))
        .when(first.rlike(_NUMBER), first.try_cast("double"))
        .when(bare.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
        .when(bare.isin("-inf", "-infinity"), F.lit(float("-inf")))
        .otherwise(F.lit(0.0))
    )
