"""Zipped feed files as a data source: one partition per archive, in batch and as a stream."""

from __future__ import annotations

import json
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewire.sources.gkg import parse_lines

FORMAT = "zipped_lines"
LINES_PER_BATCH = 20_000
READ_BYTES = 1 << 20
SCHEMA = pa.schema([("path", pa.string()), ("line_no", pa.int64()), ("value", pa.string())])
DAMAGED = (zipfile.BadZipFile, zlib.error, IndexError, EOFError, RuntimeError, NotImplementedError, OSError, ValueError)


@dataclass
class Archive(InputPartition):
    path: str  # as listed
    inner: str  # within its file system


def listed(folder: str, names: list[str] | None) -> list[tuple[int, Archive]]:
    """(time of change, archive) of the archives in a folder, by time and path; only those of ``names``, where given."""
    where, inner = fs.FileSystem.from_uri(folder)
    wanted = [f"{inner}/{n}" for n in names] if names is not None else fs.FileSelector(inner)
    files = [f for f in where.get_file_info(wanted) if f.is_file and f.path.endswith(".zip")]
    return sorted(((f.mtime_ns or 0, Archive(f"{folder.rstrip('/')}/{f.base_name}", f.path)) for f in files), key=lambda x: (x[0], x[1].path))


def lines_of(folder: str, archive: Archive, skip_damaged: bool) -> Iterator[pa.RecordBatch]:
    """The lines of the first entry, as they are inflated. An entry's checksum is only known at its end, so damaged
    archives can be left out as a whole only if each entry is read through once before."""
    where, _ = fs.FileSystem.from_uri(folder)
    with where.open_input_file(archive.inner) as content:
        try:
            archive_file = zipfile.ZipFile(content)
            first = archive_file.namelist()[0]
            if skip_damaged:
                with archive_file.open(first) as entry:
                    while entry.read(READ_BYTES):
                        pass
            entry = archive_file.open(first)
        except DAMAGED as e:
            if skip_damaged:
                return
            raise ValueError(f"damaged archive: {archive.path}") from e
        rest, start = b"", 0
        while True:
            block = entry.read(READ_BYTES)
            lines = (rest + block).split(b"\n")
            rest = lines.pop() if block else b""
            if not block and lines and not lines[-1]:
                lines.pop()
            for i in range(0, len(lines), LINES_PER_BATCH):
                text = [x.rstrip(b"\r").decode("utf-8", "replace") for x in lines[i : i + LINES_PER_BATCH]]
                number = pa.array(range(start, start + len(text)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([archive.path] * len(text)), number, pa.array(text, pa.string())], schema=SCHEMA)
                start += len(text)
            if not block:
                return


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.names = json.loads(options["names"]) if "names" in options else None
        self.skip = options.get("damaged", "skip") == "skip"

    def read(self, archive: Archive | None) -> Iterator[pa.RecordBatch]:
        """Without an archive in the folder, Spark asks for one partition that is none."""
        return iter(()) if archive is None else lines_of(self.folder, archive, self.skip)


class ArchiveReader(_Reader, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [a for _, a in listed(self.folder, self.names)]


class ArchiveStreamReader(_Reader, DataSourceStreamReader):
    """Archives in the order of their time of change; the offset is the last one taken."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = listed(self.folder, self.names)
        return {"at": found[-1][0], "path": found[-1][1].path} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, last = (start["at"], start["path"]), (end["at"], end["path"])
        return [a for at, a in listed(self.folder, self.names) if after < (at, a.path) <= last]


class ZippedLines(DataSource):
    """Options: ``path``, a folder that driver and executors reach by the same name; ``names``, a JSON list of the
    archives to read; ``damaged``, ``skip`` (no lines of such an archive) or ``fail``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, line_no long, value string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ArchiveStreamReader(self.options)


def read_archives(spark: SparkSession, folder: str, names: list[str] | None = None, damaged: str = "skip") -> DataFrame:
    """(path, line_no, value): the lines of the archives in ``folder``; an archive is read as a stream, never held."""
    spark.dataSource.register(ZippedLines)
    reader = spark.read.format(FORMAT).option("damaged", damaged)
    return (reader if names is None else reader.option("names", json.dumps(names))).load(folder)


def stream_archives(spark: SparkSession, folder: str, damaged: str = "skip") -> DataFrame:
    """The same as a stream that takes each archive once, as it lands.

    Archives go by their time of change: one that lands with a time before that of an archive already taken is passed by.
    """
    spark.dataSource.register(ZippedLines)
    return spark.readStream.format(FORMAT).option("damaged", damaged).load(folder)


def read_zipped_gkg(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the zipped feed files in a folder."""
    return parse_lines(read_archives(spark, folder))
