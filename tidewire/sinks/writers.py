"""Writing article collections, tables, CSV exports and the quality report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewire import defaults


# Times keep their microseconds, which Spark's own format would cut off.
CSV_OPTIONS = {
    "header": "true", "escape": '"', "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_articles(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(fmt).save(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Files that hold one JSON array each, a row per line; every task writes its own."""

    def run(batches):
        yield pa.RecordBatch.from_pydict({"value": ["["]})
        comma = ""
        for batch in batches:
            lines = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [(comma if i == 0 else ",") + x for i, x in enumerate(lines)]}, schema=pa.schema([("value", pa.string())]))
            comma = "," if lines else comma
        yield pa.RecordBatch.from_pydict({"value": ["]"]})

    df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]))).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def replace_table(df: DataFrame, name: str, path: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def write_dated(df: DataFrame, path: str, day: str = "published_date", mode: str = "overwrite") -> None:
    """One folder for each day; written again, the days of ``df`` are replaced and all others stay as they are.

    Rows of a day come together before they are written, in as many files as its size asks for.
    """
    df.hint("rebalance", day).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_counted(df: DataFrame, write: Callable[[DataFrame], None], **counters: Column) -> dict:
    """Write ``df`` and return aggregates over its rows, taken as they pass by: there is no second job."""
    seen = Observation()
    write(df.observe(seen, *[c.alias(name) for name, c in counters.items()]))
    return seen.get


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. ``single_file`` is for small aggregates only; articles stay in parts. Read it with ``CSV_OPTIONS``."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def existing_columns(df: DataFrame, wanted: Sequence[str] = defaults.EXPORT_COLUMNS) -> DataFrame:
    """Those of the wanted columns that exist, in the wanted order."""
    return df.select([c for c in wanted if c in df.columns])


# Captions of the quality report and the counters they show.
REPORT_LINES = [
    ("Initial Articles", "initial"),
    ("Exact URL Duplicates Removed", "url_duplicates"),
    ("MinHash Body Duplicates Removed", "body_duplicates"),
    ("Invalid/Unparseable Dates", "invalid_dates"),
    ("Articles with <50 Words", "short_bodies"),
    ("Final Cleaned Articles", "final"),
]
REPORT_TITLE = "Data Quality Report"
REPORT_RULE = "==================="


def report_text(report: DataFrame) -> DataFrame:
    """(value): the lines of the report, from its one row of counters."""
    lines: list[Column] = [F.lit(REPORT_TITLE), F.lit(REPORT_RULE)]
    lines += [F.concat(F.lit(f"{text}: "), F.col(c).cast("string")) for text, c in REPORT_LINES]
    lines.append(F.lit(REPORT_RULE))
    return report.select(F.explode(F.array(*lines)).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    report_text(report).coalesce(1).write.mode("overwrite").text(path)
