"""Scan of landed knowledge-graph feed files: tab-separated lines without a header."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.dates import gkg_date
from tidewire.functions.fields import or_missing, parse_tone, strip_stringify, stringify

# Position of each field that is kept.
FIELDS = {"date": 0, "source": 3, "url": 4, "themes": 7, "tone_csv": 15}
LINES_PER_BATCH = 20_000
READ_BYTES = 1 << 20


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add the five fields to raw lines. Long lines keep them, short lines lack the last, blank lines go.

    The text is split on tabs only: a stray quote spoils its own line at most.
    Bytes that are no UTF-8 become the replacement character.
    """
    rest = [c for c in lines.columns if c != value]
    parts = F.split(F.make_valid_utf8(F.col(value)), "\t", -1)
    # Unfolding one struct keeps the split out of later filters: it runs once per line.
    record = F.transform(
        F.array(parts),
        lambda p: F.struct(*[or_missing(F.get(p, F.lit(i))).alias(name) for name, i in FIELDS.items()]),
    )
    return lines.filter(F.length(value) > 0).select(*rest, F.inline(record))


def read_gkg(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of all files below ``path`` with their file name; Spark reads and splits the files."""
    raw = spark.read.text(path).withColumn("file", F.col("_metadata.file_name"))
    return parse_lines(raw)


def unzip_lines(archives: DataFrame) -> DataFrame:
    """(path, line_no, value): lines of the first entry of each archive, for stores that only Spark reads.

    ``archives`` is (path, content) as read by ``binaryFile``. Lines leave in
    batches. An archive that cannot be read to its end yields no lines.
    """

    def lines_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    with archive.open(archive.namelist()[0]) as entry:
                        while entry.read(READ_BYTES):  # its checksum is only known at the end
                            pass
                    entry = archive.open(archive.namelist()[0])
                except (zipfile.BadZipFile, zlib.error, IndexError, EOFError, RuntimeError, NotImplementedError, OSError):
                    continue
                buffer: list[str] = []
                start = 0
                with io.TextIOWrapper(entry, encoding="utf-8", errors="replace", newline="\n") as text:
                    for line in text:
                        buffer.append(line.rstrip("\r\n"))
                        if len(buffer) == LINES_PER_BATCH:
                            yield frame(path, start, buffer)
                            start, buffer = start + len(buffer), []
                if buffer:
                    yield frame(path, start, buffer)

    def frame(path: str, start: int, lines: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"path": path, "line_no": range(start, start + len(lines)), "value": lines})

    return archives.select("path", "content").mapInPandas(
        lines_of, "path string, line_no long, value string"
    )


def read_slots(spark: SparkSession, root: str, slots: DataFrame, layout: str = "{slot}.gkg.csv") -> DataFrame:
    """Parsed lines of the landed files of the listed slots only, with ``slot`` and ``line_no``.

    ``layout`` says where a slot's file lies below ``root``; it may hold ``*``
    after the slot, and archives end in ``.zip``. Slots without a file are passed
    by, and no other file is opened. ``slots`` is a short list, one row per file to read.
    ``line_no`` grows along a file. In plain files it is the start of the line's split plus
    its row in the task: Spark gives a full split a task of its own, so the
    lines of a later split always get larger numbers.
    """
    names = sorted({r["slot"] for r in slots.select(F.col("slot").cast("string")).distinct().collect()})
    before, _, after = layout.partition("{slot}")
    zipped = layout.endswith(".zip")
    try:
        files = spark.read.format("binaryFile" if zipped else "text").load(f"{root.rstrip('/')}/{before}{{{','.join(names)}}}{after}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return parse_lines(spark.createDataFrame([], "slot string, line_no long, value string"))
    if zipped:
        lines = unzip_lines(files)
    else:
        row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        lines = files.select("value", F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") + row).alias("line_no"))
    below = F.substring_index("path", "/", -1 - layout.count("/"))
    slot = F.substring(below, len(before) + 1, 1 << 20)
    return parse_lines(lines.select((F.substring_index(slot, after[0], 1) if after else slot).alias("slot"), "line_no", "value"))


def article_columns(scraped_at: Column | None = None, with_tone: bool = True) -> dict[str, Column]:
    """The article record of one feed line."""
    stamp = F.current_timestamp() if scraped_at is None else scraped_at
    record = {
        "url": strip_stringify(F.col("url")),
        "source": strip_stringify(F.col("source")),
        "headline": F.lit(""),
        "published_at": gkg_date(F.col("date")),
        "scrape_at": F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        "body": F.lit(""),
    }
    if with_tone:
        record["gdelt_tone"] = parse_tone(F.col("tone_csv"))
    record["themes"] = stringify(F.col("themes"))
    return record


def to_articles(rows: DataFrame, *keep: str, scraped_at: Column | None = None, with_tone: bool = True) -> DataFrame:
    """Feed lines as article records, keeping the order columns named in ``keep``."""
    record = article_columns(scraped_at, with_tone)
    return rows.select(*keep, *[c.alias(name) for name, c in record.items()])
