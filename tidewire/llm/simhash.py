"""Near-duplicates by SimHash and a hierarchical index in Gray order (operator 10).

Fingerprints that differ in at most four of 64 bits are linked. Cut into six
blocks of bits, two linked fingerprints agree in two blocks at least, so each
is filed under its 15 pairs of blocks, and links are sought among those filed
together. There, fingerprints are sorted by Gray rank, which puts those with
few differing bits next to each other, and a tree is built over runs of them:
a node keeps the bits that all below it share. A search adds up the
differences in these shared bits on the way down and leaves out every group
whose sum exceeds the limit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.tasks import map_rows
from tidewire.operators.components import components
from tidewire.session import cut_lineage

WORDS = 4
SEED = 42
LIMIT = 4
BLOCKS = 6
FAN = 8  # children of a tree node
PART_ROWS = 2048  # fingerprints of one file that are searched in one piece
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ZERO = np.uint64(0)
# For each value of a byte, its bits, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles; zero without words."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        last = len(found) - words + 1
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts[:last].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)
    columns = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, i], minlength=256) @ BITS for i in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def text_key(text: str) -> list:
    """Two hashes that tell texts apart; a null text counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(F.lit(1), whole).alias("key1"), F.xxhash64(F.lit(2), whole).alias("key2")]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, key1, key2, fp): the fingerprint of every whole text, as a signed 64-bit number, and the hashes of ``text_key``."""

    def run(batches):
        for names, key1, key2, texts in batches:
            yield [names, key1, key2, np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)]

    rows = docs.select(F.col(doc_id).alias("doc_id"), *text_key(text), F.col(text).alias("text"))
    return map_rows(rows, run, "doc_id long, key1 long, key2 long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each value in the order where neighbours differ in one bit."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A tree over fingerprints in Gray order, for several groups at once.

    Level 0 has the fingerprints; a node above has up to ``FAN`` neighbours of
    one group below it. ``masks`` are the bits shared by all below, ``values`` these bits.
    """

    def __init__(self, fps: np.ndarray, groups: np.ndarray):
        order = np.lexsort((gray_rank(fps), groups))
        self.order, self.groups = order, groups[order]
        self.values, self.masks = [fps[order]], [np.full(len(fps), ALL)]
        self.children: list[np.ndarray] = []  # where each node's children start, level by level
        at = self.groups
        while True:
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            if len(new) == len(at):
                break
            inside = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
            starts = np.flatnonzero(inside % FAN == 0)
            first = np.repeat(self.values[-1][starts], np.diff(np.append(starts, len(at))))
            same = self.masks[-1] & ~(self.values[-1] ^ first)
            mask = np.bitwise_and.reduceat(same, starts)
            self.masks.append(mask)
            self.values.append(self.values[-1][starts] & mask)
            self.children.append(np.append(starts, len(at)))
            at = at[starts]
        self.roots = at

    def search(self, queries: np.ndarray, groups: np.ndarray, limit: int, skip=None) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all fingerprints of the query's group within ``limit`` bits; places are in Gray order.

        ``skip(level, query, node)`` may tell pairs that need not be followed.
        """
        top = len(self.values) - 1
        node = np.searchsorted(self.roots, groups)
        query = np.arange(len(queries))
        known = (node < len(self.roots)) & (self.roots[np.minimum(node, len(self.roots) - 1)] == groups)
        query, node = query[known], node[known]
        above = np.zeros(len(query), np.uint64)
        spent = np.zeros(len(query), np.uint8)
        for level in range(top, -1, -1):
            mask = self.masks[level][node]
            spent = spent + np.bitwise_count((queries[query] ^ self.values[level][node]) & mask & ~above)
            near = spent <= limit
            if skip is not None:
                near &= ~skip(level, query, node)
            query, node, spent, above = query[near], node[near], spent[near], mask[near]
            if level:
                starts = self.children[level - 1]
                count = starts[node + 1] - starts[node]
                first = np.repeat(starts[node] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
                query, spent, above = np.repeat(query, count), np.repeat(spent, count), np.repeat(above, count)
                node = first + np.arange(len(query))
        return query, node


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def _settle(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def group_stars(fps: np.ndarray, groups: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Links, as places in ``fps``, that connect whatever links within ``limit`` bits connect inside the groups.

    Searches go in blocks. After each, fingerprints found connected get one
    label, and a later search passes by every node that bears only its own label.
    """
    index = GrayIndex(fps, groups)
    n, parent = len(fps), np.arange(len(fps))
    values, at, step = index.values[0], 0, 64
    while at < n:
        low, high = [parent], [parent]
        for starts in index.children:
            low.append(np.minimum.reduceat(low[-1], starts[:-1]))
            high.append(np.maximum.reduceat(high[-1], starts[:-1]))
        end = min(n, at + step)
        own = parent[at:end]

        def same(level, query, node, low=low, high=high, own=own):
            return (low[level][node] == own[query]) & (high[level][node] == own[query])

        query, place = index.search(values[at:end], index.groups[at:end], limit, same)
        pairs = np.unique(np.stack([own[query], parent[place]], axis=1), axis=0) if len(query) else np.empty((0, 2), int)
        for a, b in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
            a, b = _root(parent, a), _root(parent, b)
            parent[max(a, b)] = min(a, b)
        parent = _settle(parent)
        at, step = end, max(64, min(4096, (1 << 20) // max(1, len(query) // (end - at + 1) + 1)))
    moved = np.flatnonzero(parent != np.arange(n))
    return index.order[moved], index.order[parent[moved]]


def _files(fp: str) -> list:
    """For each pair of blocks: the column with its number and the bits of both blocks."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(BLOCKS)]
    keys = []
    for i, (a, b) in enumerate(combinations(masks, BLOCKS - LIMIT)):
        signed = (a | b) - (1 << 64) if (a | b) >> 63 else a | b
        keys.append(F.struct(F.lit(i).cast("byte").alias("no"), F.col(fp).bitwiseAND(F.lit(signed)).alias("bits")))
    return keys


def link_stars(fps: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(u, v): links among distinct fingerprints that connect the same ones as all pairs within the limit do.

    A file with many fingerprints is split by hash into parts, and each two
    parts are searched together, so no task depends on how full a file is.
    """
    filed = fps.select("fp", F.explode(F.array(*_files("fp"))).alias("file"))
    sizes = filed.groupBy("file").count().filter(F.col("count") > part_rows)
    parts = sizes.select("file", F.ceil(F.col("count") / part_rows).cast("int").alias("parts"))
    split = filed.join(parts, "file", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, own).alias("a"), F.greatest(i, own).alias("b")))
    pieces = split.withColumn("pair", F.explode(others))
    key = F.xxhash64("file.no", "file.bits", "pair.a", "pair.b").alias("key")
    shuffles = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.select(key, "fp").repartition(shuffles, "key").sortWithinPartitions("key")

    def run(batches):
        kept_keys, kept_fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for keys, fps in batches:
            keys = np.concatenate([kept_keys, np.array(keys, np.int64)])
            fps = np.concatenate([kept_fps, np.array(fps, np.int64).view(np.uint64)])
            open_at = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            kept_keys, kept_fps = keys[open_at:], fps[open_at:]
            if open_at >= 20_000:
                yield stars(keys[:open_at], fps[:open_at])
            else:
                kept_keys, kept_fps = keys, fps
        if len(kept_keys):
            yield stars(kept_keys, kept_fps)

    def stars(keys, fps):
        shared = np.concatenate([[False], keys[1:] == keys[:-1]])
        shared[:-1] |= shared[1:]
        keys, fps = keys[shared], fps[shared]
        a, b = group_stars(fps, keys) if len(keys) else (np.empty(0, int), np.empty(0, int))
        return [fps[a].view(np.int64), fps[b].view(np.int64)]

    return map_rows(dealt, run, "u long, v long")


def classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key1, key2, fp, component, component_id) of every row; ``component`` is a fingerprint of its class."""
    rows = cut_lineage(fingerprints(docs, doc_id, text))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = components(link_stars(distinct.select("fp")))
    labelled = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left")
    labelled = labelled.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(labelled.join(ids, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): every row of ``docs`` with its class of near-duplicates.

    ``component_id`` is the smallest id that can be reached over links of at
    most ``LIMIT`` bits. Null and empty texts, and those without a word, have fingerprint zero
    and are linked like any other. Repeated rows each get their row. Null ids
    do not count as smallest; a class that has no other id has a null one. An empty table gives no rows.
    """
    found = classes(docs, doc_id, text)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class stays, all columns unchanged: that with the smallest id, null ids coming last.

    If several rows of the class have this id, the hashes of their texts decide, then those of all their columns. Columns of any name
    may be there; maps do not help to decide.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key1", "key2")
    kept = cut_lineage(classes(docs, doc_id, text).groupBy("component").agg(F.min(order).alias("least")).select("least.doc_id", "least.key1", "least.key2"))
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind]
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("whole")
    rows = docs.select(whole, F.xxhash64(*plain).alias("order"), F.col(doc_id).cast("long").alias("doc_id"), *text_key(text)).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.key1") == F.col("k.key1")) & (F.col("r.key2") == F.col("k.key2"))
    own = rows.join(kept.alias("k"), same, "left_semi")
    one = own.groupBy("doc_id", "key1", "key2").agg(F.min_by("whole", "order").alias("whole"))
    return one.select(*[F.col("whole")[c].alias(c) for c in docs.columns])
