"""Small building blocks of column expressions."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LITERAL_ENTRIES = 200_000


def dict_lookup(key: Column, mapping: Mapping[str, object], value_type: str) -> Column:
    """``mapping[key]``, or NULL.

    The dictionary is one constant: an array of small maps addressed by the
    CRC of the key, so a lookup costs one hash and a scan of about one entry
    (a single map value would be scanned from the front). It travels with the
    plan, hence the size check.
    """
    if len(mapping) > MAX_LITERAL_ENTRIES:
        raise ValueError(f"{len(mapping)} entries: join the table instead of embedding it")
    n = max(1, len(mapping))
    shelves: list[dict] = [{} for _ in range(n)]
    for k, v in mapping.items():
        shelves[zlib.crc32(k.encode("utf-8")) % n][k] = v
    table = F.from_json(F.lit(json.dumps(shelves)), f"array<map<string,{value_type}>>")
    return F.try_element_at(F.get(table, (F.crc32(key) % F.lit(n)).cast("int")), key)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    Inside the lambda of ``transform`` and its like, an outer expression would
    be computed anew for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
