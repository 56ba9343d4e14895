"""A content-addressed archive of web records (operator 1).

Payload bytes are stored once, under their SHA-256; the exact header bytes of
every record are stored apart, with that digest. A join puts the original
records together again, and each payload is checked against its digest then.
Of the records with equal payloads one is the response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.tasks import map_rows, read_file, write_file
from tidewire.session import scratch_path

# The syntax of the archive format.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STAGED = "page_id long, url string, sha256 binary, sha1 string, payload_bytes long, payload binary"
FILE_BYTES = 32 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id, sha1: str) -> str:
    """The record's URI, the same whenever the same page is archived."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{sha1}')}>"


def _one_line(text) -> str:
    """A header value: line ends and other controls would break the header."""
    return "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in text or "")


def http_header(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def record_header(page_id, url, sha1: str, payload_bytes: int, refers_to, date: str) -> bytes:
    """The exact bytes before a record's block; ``refers_to`` is the page of the response for revisits."""
    http = http_header(payload_bytes)
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id, sha1)}"]
    lines += [f"WARC-Date: {date}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{sha1}"]
    lines += [f"X-Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_name(refers_to, sha1)}", f"WARC-Profile: {REVISIT}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (payload_bytes if refers_to is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, HTTP header, payload) of one record's bytes."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(headers["Content-Length"])
    if version != VERSION or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return headers, http + b"\r\n\r\n", payload


def write_archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", folder: str | None = None) -> str:
    """Archive every row of ``pages``; returns the folder, with a table ``payloads`` and a table ``headers``.

    A null payload is stored as an empty one; empty payloads are shared like
    any other. Of equal payloads the smallest id is the response, and of rows
    that repeat this id one is. A null id counts as larger than any other.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "archive")

    def stage(batches):
        seen: set[bytes] = set()  # payloads that this task has already handed on
        for ids, urls, texts in batches:
            out = [ids, urls, [], [], [], []]
            for text in texts:
                payload = (text or "").encode("utf-8", "replace")
                digest = hashlib.sha256(payload).digest()
                for column, value in zip(out[2:], (digest, base32_sha1(payload), len(payload), None if digest in seen else payload), strict=True):
                    column.append(value)
                seen.add(digest)
            yield out

    staged = map_rows(pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(html).cast("string")), stage, STAGED)
    staged.write.option("compression", "zstd").parquet(f"{folder}/staged")
    staged = spark.read.parquet(f"{folder}/staged").withColumn("no", F.struct(F.col("_metadata.file_name"), F.col("_metadata.row_index")))
    # Each task has handed on a payload at most once, so few copies of one meet here; equal digests must mean equal bytes.
    first = staged.filter("payload IS NOT NULL").select("sha256", "sha1", "payload_bytes", "payload")
    dealt = first.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sha256").sortWithinPartitions("sha256")

    def store(batches):
        last, kept = None, None
        for columns in batches:
            fresh = []
            for row in zip(*columns, strict=True):
                if row[0] == last:
                    if row[3] != kept:
                        raise ValueError("two payloads have one digest")
                else:
                    fresh.append(row)
                    last, kept = row[0], row[3]
            yield [list(c) for c in zip(*fresh, strict=True)] if fresh else [[], [], [], []]

    map_rows(dealt, store, "sha256 binary, sha1 string, payload_bytes long, payload binary").write.option("compression", "zstd").parquet(f"{folder}/payloads")
    rank = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("no"))
    owners = staged.groupBy("sha256").agg(F.min(rank).alias("owner"))
    narrow = staged.select("page_id", "url", "sha256", "sha1", "payload_bytes", "no").join(owners, "sha256")
    is_first = F.col("owner")["no"] == F.col("no")
    narrow = narrow.select("page_id", "url", "sha256", "sha1", "payload_bytes", (~is_first).alias("again"), F.col("owner")["page_id"].alias("owner_id"))

    def head(batches):
        for ids, urls, digests, sha1s, sizes, again, owner_ids in batches:
            refers = [("" if o is None else o) if a else None for a, o in zip(again, owner_ids, strict=True)]
            heads = [record_header(*r, date) for r in zip(ids, urls, sha1s, sizes, refers, strict=True)]
            yield [ids, digests, again, [o if a else None for a, o in zip(again, owner_ids, strict=True)], heads]

    map_rows(narrow, head, "page_id long, sha256 binary, again boolean, refers_to long, header binary").write.parquet(f"{folder}/headers")
    return folder


def _responses_and_revisits(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """(page_id, record, sha256, again) of both kinds: the original bytes, put together from headers and payloads.

    A revisit's block ends after its HTTP header, so only responses, one for each payload, are joined with payloads.
    """
    heads, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    end = F.lit(b"\r\n\r\n")
    whole = heads.filter("NOT again").join(payloads.select("sha256", "payload"), "sha256")
    whole = whole.select("page_id", F.concat("header", "payload", end).alias("record"), "sha256", "again")
    return whole, heads.filter("again").select("page_id", F.concat("header", end).alias("record"), "sha256", "again")


def read_records(spark, folder: str) -> DataFrame:
    """(page_id, record, sha256, again): the original bytes of every record."""
    responses, revisits = _responses_and_revisits(spark, folder)
    return responses.unionByName(revisits)


def verified_payloads(spark, folder: str) -> DataFrame:
    """(sha256, payload_bytes, payload_digest) of every stored payload, computed anew; one that does not agree with its digest fails the job."""

    def run(batches):
        for digests, payloads in batches:
            for digest, payload in zip(digests, payloads, strict=True):
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError("a payload does not agree with its digest")
            yield [digests, list(map(len, payloads)), list(map(base32_sha1, payloads))]

    stored = spark.read.parquet(f"{folder}/payloads").select("sha256", "payload")
    return map_rows(stored, run, "sha256 binary, payload_bytes long, payload_digest string")


def read_archive(spark, folder: str, payloads: bool = True) -> DataFrame:
    """One row per archived page, as its record says: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload.

    Each response is verified as it is put together; a revisit is held against the length and digest of its payload,
    computed anew from the stored one. A record that does not agree with its payload
    fails the job. Without ``payloads`` the rows carry none; with them each gets its own, revisits too.
    """

    def run(batches):
        for ids, records, digests, sizes, sha1s in batches:
            out = [[] for _ in range(7)]
            for page, record, digest, size, sha1 in zip(ids, records, digests, sizes, sha1s, strict=True):
                headers, _, payload = parse_record(record)
                again = headers["WARC-Type"] == "revisit"
                if sha1 is None:  # a response has its payload with it
                    if hashlib.sha256(payload).digest() != digest:
                        raise ValueError("a payload does not agree with its digest")
                    size, sha1 = len(payload), base32_sha1(payload)
                if headers["WARC-Payload-Digest"] != f"sha1:{sha1}" or len(payload) != (0 if again else size):
                    raise ValueError(f"page {page}: the payload does not agree with its digest")
                refers = headers.get("X-Refers-To-Page") or None
                values = (page, headers["WARC-Target-URI"], size, sha1, headers["WARC-Type"], refers and int(refers), digest)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield out

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, sha256 binary"
    responses, revisits = _responses_and_revisits(spark, folder)
    # Whole records do not meet another shuffle: only revisits, which have no payload, are joined with facts about theirs.
    responses = responses.withColumns({"payload_bytes": F.lit(None).cast("long"), "payload_digest": F.lit(None).cast("string")})
    known = responses.unionByName(revisits.join(verified_payloads(spark, folder), "sha256"))
    found = map_rows(known.select("page_id", "record", "sha256", "payload_bytes", "payload_digest"), run, schema)
    if not payloads:
        return found.drop("sha256")
    return found.join(spark.read.parquet(f"{folder}/payloads").select("sha256", "payload"), "sha256").drop("sha256")


def export_warc(spark, folder: str, to: str) -> DataFrame:
    """Write the records as ordinary ``.warc.gz`` files below ``to``, a member per record; returns (path, records)."""

    def run(batches):
        held, size, count = [], 0, 0
        for (records,) in batches:
            for record in records:
                held.append(gzip.compress(record, 1, mtime=0))
                size, count = size + len(held[-1]), count + 1
                if size >= FILE_BYTES:
                    yield [[write_file(to, f"{uuid.uuid4().hex}.warc.gz", b"".join(held))], [count]]
                    held, size, count = [], 0, 0
        if held:
            yield [[write_file(to, f"{uuid.uuid4().hex}.warc.gz", b"".join(held))], [count]]

    map_rows(read_records(spark, folder).select("record"), run, "path string, records long").write.parquet(f"{to}/manifest")
    return spark.read.parquet(f"{to}/manifest")


def read_warc(files: DataFrame) -> DataFrame:
    """(page_id, record_type, payload): the records of listed ``.warc.gz`` files."""

    def run(batches):
        for (paths,) in batches:
            for path in paths:
                content, at = gzip.decompress(read_file(path)), 0
                while at < len(content):
                    block = content.index(b"\r\n\r\n", at) + 4
                    head = content[at:block]
                    size = int(head.split(b"\r\nContent-Length: ")[1].split(b"\r\n")[0])
                    end = block + size + 4
                    headers, _, payload = parse_record(content[at:end])
                    yield [[int(headers["X-Page-ID"]) if headers["X-Page-ID"] else None], [headers["WARC-Type"]], [payload]]
                    at = end

    return map_rows(files.select("path"), run, "page_id long, record_type string, payload binary")
