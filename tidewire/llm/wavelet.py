"""Token ids on disk as wavelet matrices, one compressed file per shard (operator 4).

A wavelet matrix keeps a sequence of ids as bit-planes, highest bit first. On
each plane the ids are ordered by the bits already used: those with a 0 before
those with a 1, each part in its former order. With rank and select on the
planes, a file answers: the id at a place, how often an id occurs before a
place, and where its k-th occurrence is, without decoding the rest.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.tasks import map_rows, read_file, write_file
from tidewire.llm.tokens import encoded
from tidewire.session import shared_dir

MAGIC = b"WVMX0001"
BLOCK = 512  # bits between two entries of a plane's rank directory
SHARD_TOKENS = 2_000_000
STRETCH = 1 << 15  # ids that are dealt to the two parts of a plane at a time: they stay in the processor's cache
RANGE_ROWS = 8192  # documents per task that writes, unless there are more tasks anyway
READ_FILES = 4  # files per task that reads


def build(ids: np.ndarray) -> tuple[int, list[int], list[np.ndarray]]:
    """(levels, zeros per level, packed plane per level) of an array of ids."""
    levels = max(1, int(ids.max(initial=0)).bit_length())
    order = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    after, bits = np.empty_like(order), np.empty(len(order), bool)
    zeros, planes = [], []
    for level in range(levels - 1, -1, -1):
        one = order.dtype.type(1 << level)
        for i in range(0, len(order), STRETCH):
            np.not_equal(order[i : i + STRETCH] & one, 0, out=bits[i : i + STRETCH])
        planes.append(np.packbits(bits))
        low, high = 0, len(order) - int(np.count_nonzero(bits))
        zeros.append(high)
        for i in range(0, len(order) if level else 0, STRETCH):
            bit, part = bits[i : i + STRETCH], order[i : i + STRETCH]
            zero, one = part.take(np.flatnonzero(~bit)), part.take(np.flatnonzero(bit))
            after[low : low + len(zero)], after[high : high + len(one)] = zero, one
            low, high = low + len(zero), high + len(one)
        order, after = after, order
    return levels, zeros, planes


def pack_shard(ids: np.ndarray, names: list, ends: np.ndarray) -> bytes:
    """The bytes of a shard file: ids of some documents, their names, and where each ends."""
    levels, zeros, planes = build(ids)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = [squeeze(json.dumps(names).encode()), squeeze(np.diff(ends, prepend=0).astype("<i8").tobytes())]
    for plane in planes:
        ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        parts += [squeeze(plane.tobytes()), squeeze(ranks.tobytes())]
    head = json.dumps({"n": len(ids), "levels": levels, "zeros": zeros, "block": BLOCK, "sizes": [len(p) for p in parts]}).encode()
    body = MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """One shard file. Planes are unpacked when first used."""

    def __init__(self, content: bytes):
        body, (crc,) = content[:-4], struct.unpack("<I", content[-4:])
        if body[:8] != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("damaged token file")
        (size,) = struct.unpack("<I", body[8:12])
        head = json.loads(body[12 : 12 + size])
        self.n, self.levels, self.zeros, self.block = head["n"], head["levels"], head["zeros"], head["block"]
        at = np.concatenate([[0], np.cumsum(head["sizes"])]) + 12 + size
        self._parts = [body[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.names = json.loads(self._open(0))
        self.ends = np.cumsum(np.frombuffer(self._open(1), "<i8"))

    def _open(self, part: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._parts[part])

    def plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Packed bits and ranks at block starts."""
        if level not in self._planes:
            bits = np.frombuffer(self._open(2 + 2 * level), np.uint8)
            self._planes[level] = bits, np.frombuffer(self._open(3 + 2 * level), "<u4")
        return self._planes[level]

    def bit(self, level: int, at: int) -> int:
        return int(self.plane(level)[0][at >> 3] >> (7 - (at & 7))) & 1

    def rank1(self, level: int, at: int) -> int:
        """Ones before ``at``."""
        bits, ranks = self.plane(level)
        start = at // self.block * self.block
        within = np.unpackbits(bits[start >> 3 : (at + 7) >> 3])[: at - start]
        return int(ranks[at // self.block]) + int(within.sum())

    def select(self, level: int, one: int, k: int) -> int:
        """Where the k-th (from 0) bit of this kind is."""
        bits, ranks = self.plane(level)
        starts = np.arange(len(ranks), dtype=np.int64) * self.block
        before = ranks if one else starts - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        start = block * self.block
        here = np.unpackbits(bits[start >> 3 : (start + self.block) >> 3])
        return start + int(np.flatnonzero(here == one)[k - int(before[block])])

    def access(self, at: int) -> int:
        """The id at a place."""
        value = 0
        for level in range(self.levels):
            one = self.bit(level, at)
            value = value << 1 | one
            ones = self.rank1(level, at)
            at = self.zeros[level] + ones if one else at - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        start = 0
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            low, high = self.rank1(level, start), self.rank1(level, end)
            if token >> (self.levels - 1 - level) & 1:
                start, end = self.zeros[level] + low, self.zeros[level] + high
            else:
                start, end = start - low, end - high
        return start, end

    def count(self, token: int, end: int | None = None) -> int:
        """How often an id occurs before ``end``."""
        start, stop = self._range(token, self.n if end is None else end)
        return stop - start

    def occurrence(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id."""
        start, stop = self._range(token, self.n)
        if not 0 <= k < stop - start:
            raise IndexError(k)
        at = start + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            at = self.select(level, one, at - self.zeros[level] if one else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, in order."""
        order = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        before = np.empty_like(order)
        for level in range(self.levels - 1, -1, -1):
            plane, low, high = self.plane(level)[0], 0, self.zeros[level]
            order[high:] |= order.dtype.type(1 << (self.levels - 1 - level))
            for i in range(0, self.n, STRETCH):
                part = before[i : i + STRETCH]
                bit = np.unpackbits(plane[i >> 3 : (i + STRETCH) >> 3], count=len(part)).view(bool)
                zero, one = np.flatnonzero(~bit), np.flatnonzero(bit)
                part[zero], part[one] = order[low : low + len(zero)], order[high : high + len(one)]
                low, high = low + len(zero), high + len(one)
            order, before = before, order
        return order


def write_token_files(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 0,
    folder: str | None = None, shards: int | None = None, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Encode every text and write the ids in ascending order of ``doc_id``; returns the manifest.

    The manifest has a row per file: shard (ascending with the documents),
    path, tokens, documents. Files of tasks that were run again have names of
    their own and are not in it. A null text counts as empty: only ``end_id``.
    A null id sorts first. Rows with equal ids stay together, ordered by text.
    ``folder`` must be shared by all executors; it defaults to one below ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_ROWS))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.uint32(end_id).tobytes()

    def write(batches):
        from pyspark import TaskContext

        part, pending, names, ends, held = TaskContext.get().partitionId(), [], [], [], 0
        done = 0

        def flush():
            ids = np.frombuffer(b"".join(pending), "<u4")
            name = f"{part:06d}-{done:06d}-{uuid.uuid4().hex}.wvm"
            return [[part], [done], [write_file(folder, name, pack_shard(ids, names, np.array(ends)))], [len(ids)], [len(names)]]

        for doc_ids, found in encoded(tokenizer, batches):
            for name, ids in zip(doc_ids, found, strict=True):
                pending += [ids, end]
                held += len(ids) // 4 + 1
                names.append(name)
                ends.append(held)
                if held >= shard_tokens:
                    yield flush()
                    pending, names, ends, held, done = [], [], [], 0, done + 1
        if names:
            yield flush()

    files = map_rows(ordered, write, "part int, piece int, path string, tokens long, documents long")
    manifest = f"{folder}/manifest"
    files.write.parquet(manifest)
    return spark.read.parquet(manifest).withColumn("shard", F.struct("part", "piece"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files; ids are little-endian 32-bit, as bytes.

    ``start`` counts the ids of all documents before.
    """

    def read(batches):
        for paths, bases in batches:
            for path, base in zip(paths, bases, strict=True):
                shard = Shard(read_file(path))
                ids, ends = shard.decode().astype("<u4"), shard.ends
                starts = np.concatenate([[0], ends[:-1]])
                for i in range(0, len(ends), 256):
                    s, e = starts[i : i + 256], ends[i : i + 256]
                    yield [shard.names[i : i + 256], (s + base).tolist(), (e - s).tolist(), [ids[p:q].tobytes() for p, q in zip(s, e, strict=True)]]

    # Sizes are summed within each range of documents first; only one row per range meets in one place.
    inside = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = manifest.groupBy("part").agg(F.sum("tokens").alias("all")).withColumn("first", F.coalesce(F.sum("all").over(before), F.lit(0)))
    sized = manifest.join(ranges, "part").withColumn("base", F.col("first") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    files = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-manifest.count() // READ_FILES))
    tasks = sized.select("path", "base").repartition(files)
    return map_rows(tasks, read, "doc_id long, start long, n_tokens long, ids binary")


def token_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the files."""
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
