"""Exact similarity join of word sets: all links at a Jaccard similarity, as link counts and classes.

Words are put in one order, rare ones first. Two sets that are similar enough
share a word among the first ``n - ceil(t n) + 1`` of each, so every set is filed
under these words alone. Under a word, pairs are sifted by size, place and a bitmap of
the set, each of which can only leave out pairs that do not link, and by the first words of both, which tell
where a pair has met already. What is left is sifted again by a bitmap as wide as the set needs, and sets with a pair left
are fetched and compared in full. A pair counts under its first common word only, so a set is fetched for few of its words.
Pairs are never rows: tasks add up links and hand on one star per connected group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewire.operators.components import components
from tidewire.session import cut_lineage

THRESHOLD = 0.8
BUCKETS = 1 << 18  # counts that decide which words are rare: bounds what every task is sent
BITS = 512
PART_ROWS = 512  # sets under one word that are compared in one piece
SIEVE_ROWS = 4096  # rows under one word that are sifted in one piece
SLICE = 256  # of these, rows that meet all others at a time
MAP_BYTES = 1 << 22  # bitmaps compared at a time
HEAD = 8  # first words that go with every row, to tell where a pair has met before
COLUMNS = 4096
SETS = "node long, seq long, size int, digest binary, words binary"
FILED = "word long, rep long, size int, place int, bits binary, head binary"


def word_hashes(tokens: Column) -> Column:
    """A 64-bit hash of each different word."""
    return F.transform(F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>"))), lambda w: F.xxhash64(w))


def _mapped(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn`` turns each Arrow batch into lists of columns of ``schema``."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column, as arrays."""
    values, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
    return (values[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))


def word_sets(df: DataFrame, seq: str, tokens: str) -> DataFrame:
    """(node, seq, size, digest, words): the word set of each row; ``node`` numbers the rows, equal sets have equal digests."""

    def run(batches):
        for b in batches:
            if len(b):
                sets = [np.sort(x).tobytes() for x in _lists(b.column(2))]
                yield [b.column(0), b.column(1), [len(s) // 8 for s in sets], [hashlib.sha256(s).digest() for s in sets], sets]

    rows = df.select(F.monotonically_increasing_id().alias("node"), F.col(seq).cast("long").alias("seq"), word_hashes(F.col(tokens)).alias("words"))
    return _mapped(rows, run, SETS)


def rarity(sets: DataFrame) -> np.ndarray:
    """How many sets have a word of each bucket of hashes."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for s in b.column(0).to_pylist():
                np.add.at(counts, _buckets(np.frombuffer(s, np.int64)), 1)
        some = np.flatnonzero(counts)
        yield [some, counts[some]]

    found = _mapped(sets.select("words"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> 20) & (BUCKETS - 1)


def rare_first(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """``words`` in the common order: by the count of their bucket, then by hash."""
    sent = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for b in batches:
            out = []
            for s in b.column(3).to_pylist():
                x = np.frombuffer(s, np.int64)
                out.append(x[np.lexsort((x, sent.value[_buckets(x)]))].tobytes())
            yield [b.column(0), b.column(1), b.column(2), out]

    return _mapped(sets.select("rep", "n", "size", "words"), run, "rep long, n long, size int, words binary")


def prefix_length(size: int, threshold: float) -> int:
    return size - math.ceil(threshold * size - 1e-9) + 1


def bitmap(words: np.ndarray, bits: int) -> bytes:
    """Which of ``bits`` places the words fall on; folded in halves it is the map of half as many places."""
    there = np.zeros(bits, np.uint8)
    there[words & (bits - 1)] = 1
    return np.packbits(there).tobytes()


def file_prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(word, rep, size, place, bits, head): each set under the first words of its order; ``head`` has the very first of all."""

    def run(batches):
        for b in batches:
            words, reps, sizes, places, bits, heads = [], [], [], [], [], []
            for rep, size, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x, n = np.frombuffer(s, np.int64), prefix_length(size, threshold)
                words.append(x[:n])
                reps += [rep] * n
                sizes += [size] * n
                places += range(n)
                bits += [bitmap(x, BITS)] * n
                heads += [s[: 8 * HEAD]] * n
            if words:
                yield [np.concatenate(words), reps, sizes, places, bits, heads]

    return _mapped(sets.filter("size > 0").select("rep", "size", "words"), run, FILED)


def wide_maps(sets: DataFrame) -> DataFrame:
    """(rep, size, bits, head) of each set, with at least two places a word: a 32nd of the set."""

    def run(batches):
        for b in batches:
            reps, sizes, sets = (b.column(i).to_pylist() for i in range(3))
            maps = [bitmap(np.frombuffer(s, np.int64), max(BITS, 1 << (2 * n - 1).bit_length())) for n, s in zip(sizes, sets, strict=True)]
            yield [reps, sizes, maps, [s[: 8 * HEAD] for s in sets]]

    return _mapped(sets.filter("size > 0").select("rep", "size", "words"), run, "rep long, size int, bits binary, head binary")


def by_word(rows: DataFrame, part_rows: int) -> DataFrame:
    """``rows`` with ``a``, ``b`` and ``own``, dealt out and sorted by (word, a, b).

    A word with many rows is cut by hash into parts, and each two parts meet, so no task depends on
    how common a word is. ``own`` tells the part of the row; a group with a = b compares its rows among themselves.
    The list of such words has at most a row for every ``part_rows`` rows; it is sent to the rows, which are shuffled once.
    """
    hot = rows.groupBy("word").count().filter(F.col("count") > part_rows).select("word", F.ceil(F.col("count") / part_rows).cast("int").alias("parts"))
    cut = rows.join(F.broadcast(hot), "word", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, "own").alias("a"), F.greatest(i, "own").alias("b")))
    spread = cut.withColumn("meets", F.explode(meets)).withColumns({"a": F.col("meets.a"), "b": F.col("meets.b")}).drop("meets", "parts")
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(shuffles, "word", "a", "b").sortWithinPartitions("word", "a", "b", "own")


def _groups(batches, names: list[str]) -> Iterator[tuple[tuple, list]]:
    """((word, a, b), rows) of sorted batches."""
    at, held = None, []
    for b in batches:
        for row in zip(*(b.column(n).to_pylist() for n in names), strict=True):
            if row[:3] != at:
                if len(held) > 1:
                    yield at, held
                at, held = row[:3], []
            held.append(row[3:])
    if len(held) > 1:
        yield at, held


def needed(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """How many common words sets of these sizes need."""
    return np.ceil(threshold / (1 + threshold) * (x + y) - 1e-9)


def _sides(at: tuple, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the two parts that meet."""
    left = np.flatnonzero(own == at[1])
    return left, left if at[1] == at[2] else np.flatnonzero(own == at[2])


def _possible(left: np.ndarray, right: np.ndarray, same: bool, size: np.ndarray, place: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of these rows that sizes and places allow to link, with this word as their first common one; each pair once if both sides are the ``same`` part."""
    x, y = size[left][:, None], size[right][None]
    need = needed(x, y, threshold)
    ok = np.minimum(x - place[left][:, None], y - place[right][None]) >= need
    ok &= place[left][:, None] + place[right][None] <= x + y - 2 * need
    if same:
        ok &= left[:, None] < right[None]
    i, j = np.nonzero(ok)
    return left[i], right[j]


def _met_before(heads: np.ndarray, known: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the first words of each two rows, those before the word of the rows, have one in common."""
    out = np.zeros(len(i), bool)
    for k in range(HEAD):
        out |= ((heads[j] == heads[i, k][:, None]) & known[j] & known[i, k][:, None]).any(axis=1)
    return out


class Bitmaps:
    """Bitmaps of rows; two are compared at the length of the shorter."""

    def __init__(self, maps: list[bytes]):
        self.maps, self.lengths, self.folded = maps, np.array(list(map(len, maps))), {}

    def of_length(self, n: int) -> np.ndarray:
        if n not in self.folded:
            out = np.zeros((len(self.maps), n), np.uint8)
            for r in np.flatnonzero(self.lengths >= n):
                out[r] = np.bitwise_or.reduce(np.frombuffer(self.maps[r], np.uint8).reshape(-1, n), axis=0)
            self.folded[n] = out.view(np.uint64)
        return self.folded[n]

    def differences(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many places the maps of each two rows differ."""
        least, out = np.minimum(self.lengths[x], self.lengths[y]), np.empty(len(x), np.int64)
        for n in np.unique(least).tolist():
            maps, at = self.of_length(n), np.flatnonzero(least == n)
            for part in np.array_split(at, 1 + len(at) * n // MAP_BYTES):
                out[part] = np.bitwise_count(maps[x[part]] ^ maps[y[part]]).sum(axis=1, dtype=np.int64)
        return out


def candidates(filed: DataFrame, threshold: float) -> DataFrame:
    """(word, rep, place): the sets that may link to another one under a word, and have not met it under one of their first words."""

    def run(batches):
        for at, rows in _groups(batches, ["word", "a", "b", "own", "rep", "size", "place", "bits", "head"]):
            own, rep, size, place = (np.array(c, np.int64) for c in zip(*(r[:4] for r in rows), strict=True))
            left, right = _sides(at, own)
            maps, heads, met = None, None, np.zeros(len(rows), bool)
            for start in range(0, len(left), SLICE):
                i, j = _possible(left[start : start + SLICE], right, at[1] == at[2], size, place, threshold)
                if not len(i):
                    continue
                if maps is None:
                    maps, known = Bitmaps([r[4] for r in rows]), np.arange(HEAD)[None] < place[:, None]
                    heads = np.frombuffer(b"".join(r[5].ljust(8 * HEAD, b"\0") for r in rows), np.int64).reshape(len(rows), HEAD)
                # Words that set a bit in one set only belong to that set only.
                near = maps.differences(i, j) <= size[i] + size[j] - 2 * needed(size[i], size[j], threshold)
                i, j = i[near], j[near]
                # A pair counts under its first common word, which is an earlier one for some.
                new = ~_met_before(heads, known, i, j)
                met[i[new]] = met[j[new]] = True
            if met.any():
                yield [[at[0]] * int(met.sum()), rep[met], place[met]]

    return _mapped(by_word(filed, SIEVE_ROWS), run, "word long, rep long, place int").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets have in common."""
    names, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(names), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        there = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        there[rows[a:b], column[a:b] - start] = 1
        out += there[: len(left)] @ there[len(left) :].T
    return out.astype(np.int64)


def links(filed: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, low): of each set, how many texts it links to under a word, and a lower set it is connected with there, if any."""

    def run(batches):
        for at, rows in _groups(batches, ["word", "a", "b", "own", "rep", "n", "size", "place", "words"]):
            own, rep, n, size, place = (np.array(c, np.int64) for c in zip(*(r[:5] for r in rows), strict=True))
            i, j = _possible(*_sides(at, own), at[1] == at[2], size, place, threshold)
            if not len(i):
                continue
            sets = [np.frombuffer(r[5], np.int64) for r in rows]
            one, i = np.unique(i, return_inverse=True)
            two, j = np.unique(j, return_inverse=True)
            common = overlaps([sets[r] for r in one], [sets[r] for r in two])[i, j]
            linked = common / (size[one][i] + size[two][j] - common) >= threshold
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            first = overlaps([sets[r][: place[r]] for r in one], [sets[r][: place[r]] for r in two])[i, j] == 0
            i, j = one[i[first]], two[j[first]]
            if not len(i):
                continue
            count, low = np.zeros(len(rows), np.int64), rep.copy()
            np.add.at(count, i, n[j])
            np.add.at(count, j, n[i])
            while True:
                before = low.copy()
                np.minimum.at(low, i, low[j])
                np.minimum.at(low, j, low[i])
                if np.array_equal(low, before):
                    break
            met = np.flatnonzero(count)
            yield [rep[met], count[met], [a if a < b else None for a, b in zip(low[met].tolist(), rep[met].tolist(), strict=True)]]

    return _mapped(by_word(filed, PART_ROWS), run, "rep long, links long, low long")


def similar_sets(df: DataFrame, seq: str, tokens: str, threshold: float = THRESHOLD) -> DataFrame:
    """(seq, n_links, class_id): every row of ``df`` with what its word set links to.

    ``n_links`` counts the other rows with a Jaccard similarity of at least
    ``threshold``, those with an equal set among them; ``class_id`` is the smallest ``seq`` reached over links.
    Equal sets are compared once and count as often as they occur. An empty set equals other empty ones and links with
    nothing else. Words are told apart by 64-bit hashes: a pair with a thousand words is misjudged once in 10^13.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0, and at most 1")
    sets = cut_lineage(word_sets(df, seq, tokens))
    folded = cut_lineage(sets.groupBy("digest").agg(F.min("node").alias("rep"), F.min("seq").alias("least"), F.count("*").alias("n")))
    chosen = sets.select(F.col("node").alias("rep"), "size", "words").join(folded.select("rep", "n"), "rep")
    ordered = cut_lineage(rare_first(chosen, rarity(sets)))
    sifted = cut_lineage(candidates(file_prefixes(ordered, threshold), threshold))
    filed = cut_lineage(candidates(sifted.join(wide_maps(ordered), "rep"), threshold))
    found = cut_lineage(links(filed.join(ordered, "rep"), threshold))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    stars = components(found.filter("low IS NOT NULL").select(F.col("rep").alias("u"), F.col("low").alias("v")).distinct())
    labelled = folded.join(stars.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    ids = labelled.groupBy("component").agg(F.min("least").alias("class_id"))
    named = labelled.join(ids, "component").join(counts, "rep", "left")
    total = (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    return sets.select("seq", "digest").join(named.select("digest", total, "class_id"), "digest").select("seq", "n_links", "class_id")
