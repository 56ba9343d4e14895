"""Reading article collections, tables and small parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire import defaults, schemas


def read_articles_json(
    spark: SparkSession, path: str, schema: T.StructType = schemas.ARTICLE, array: bool = False
) -> DataFrame:
    """Articles from JSON. ``array`` reads files that hold one JSON array each (not splittable)."""
    return spark.read.schema(schema).option("multiLine", array).json(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; pass ``partitionColumn`` and bounds for a parallel read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_lexicon(spark: SparkSession, path: str) -> dict[str, float]:
    """A published tab-separated lexicon (word, valence, ...), as the constant scoring uses."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    rows = rows.select(F.lower(F.get("f", F.lit(0))).alias("w"), F.get("f", F.lit(1)).try_cast("double").alias("v"))
    few = rows.filter("w <> '' AND v IS NOT NULL").limit(200_001).collect()
    if len(few) > 200_000:
        raise ValueError("lexicon too large to embed: join it with operators.lexicon.token_valences")
    return {r["w"]: r["v"] for r in few}


def define_events(spark: SparkSession, events=None) -> DataFrame:
    return spark.createDataFrame(defaults.EVENTS if events is None else events, schemas.EVENTS)


def define_windows(spark: SparkSession, windows=None) -> DataFrame:
    """(name, start, end, window_no): the windows, numbered in the given order."""
    rows = defaults.WINDOWS if windows is None else windows
    schema = T.StructType(schemas.WINDOWS.fields + [T.StructField("window_no", T.IntegerType())])
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
