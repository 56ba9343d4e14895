"""Small helpers for work inside tasks: Arrow batches in and out, and files in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Texts in one Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS = "512"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts short, unless the session asks for shorter ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > int(BATCH_ROWS) or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, BATCH_ROWS)


def map_rows(df: DataFrame, fn: Callable[[Iterator[list[list]]], Iterable[list]], schema: str) -> DataFrame:
    """``fn`` gets an iterator of batches, each a list of columns, and yields lists of columns of ``schema``, as lists or arrays of Arrow."""
    small_batches(df.sparkSession)
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for out in fn([c.to_pylist() for c in b.columns] for b in batches):
            columns = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def write_file(folder: str, name: str, content: bytes) -> str:
    """Write one file below ``folder``, a path or URI that driver and executors share; returns its path."""
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/{name}") as out:
        out.write(content)
    return f"{folder}/{name}"


def read_file(path: str) -> bytes:
    where, inner = fs.FileSystem.from_uri(path)
    with where.open_input_stream(inner) as stream:
        return stream.read()
