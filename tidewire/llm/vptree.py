"""Nearest neighbours by inner product in vantage-point trees, one per shard (operator 9).

Inner products are turned into distances by one more component that gives all
rows the same length; the query gets a zero there. A tree splits its rows at the median distance
from a vantage point and keeps the range of distances on each side. By the triangle inequality, no row of a side
can be nearer to the query than its distance from the vantage point is out of
that range. A side is left out if this gap, times a factor, exceeds the
distance of the k-th best row so far. Factor 1 is exact; a larger one leaves out more.

A first tree, fitted on a bounded sample, deals all rows to shards: rows that are near each other come to
the same one. A query is put to the shard it would belong to, and, with the distance it has reached
there, to those others that the same test leaves open.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.tasks import map_rows
from tidewire.llm.vectors import BLOCK_ROWS, QUERY_ROWS, best, meet, one_per_id, pack, ranked
from tidewire.session import cut_lineage

LEAF_ROWS = 256
# A neighbour at distance r differs from the query in its distance to a vantage point by about r divided by the
# root of the number of components, if it lies in no special direction. The factor allows for this many of these.
DEVIATIONS = 4 / 3
SLACK = 1e-9  # larger than the rounding of a product, and than what it changes
SAMPLE_ROWS = 8192  # vectors that decide where shards are cut
MAX_SHARDS = 4096  # further rows make shards of several blocks: bounds what each task is sent


def factor_for(width: int, factor: float | None) -> float:
    """The given factor, or that for vectors of so many components."""
    return max(1.0, math.sqrt(width) / DEVIATIONS) if factor is None else factor


def vantage_point(points: np.ndarray) -> np.ndarray:
    """One far out, so that distances vary."""
    return points[np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1))]


def distance(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - vantage) ** 2).sum(axis=1))


def gap(away: np.ndarray, low, high) -> np.ndarray:
    """How much nearer than it is the query would have to be to the range of a side; a little less, for rounding."""
    return np.maximum(np.maximum(low - away, away - high) - 1e-6, 0)


class VantageTree:
    """The tree over one block of a shard."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, factor: float | None = None, leaf_rows: int = LEAF_ROWS):
        self.factor, self.ids, self.matrix = factor_for(matrix.shape[1], factor), ids, matrix
        square = (matrix**2).sum(axis=1)
        self.length = square.max()
        self.visits = 0  # rows compared with queries
        self.root = self._grow(np.column_stack([matrix, np.sqrt(np.maximum(self.length - square, 0))]), np.arange(len(ids)), leaf_rows)

    def _grow(self, points: np.ndarray, rows: np.ndarray, leaf_rows: int):
        """The node over ``rows``: their numbers, or (vantage point, distance to split at, two sides as (node, low, high))."""
        if len(rows) <= leaf_rows:
            return rows
        vantage = vantage_point(points[rows])
        away = distance(points[rows], vantage)
        order = np.argsort(away, kind="stable")
        half = len(rows) // 2
        sides = [(self._grow(points, rows[part], leaf_rows), away[part_away[0]], away[part_away[-1]])
                 for part, part_away in ((order[:half], order[:half]), (order[half:], order[half:]))]
        return vantage, (away[order[half - 1]] + away[order[half]]) / 2, sides

    def __call__(self, asked: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int):
        """The best rows found for each query. ``limits`` are inner products that a row must reach to be of use."""
        points = np.column_stack([queries, np.zeros(len(queries))])
        offset = (queries**2).sum(axis=1) + self.length  # squared distance = offset - 2 * product
        top = np.full((len(queries), k), -np.inf)
        worst = limits.astype(float).copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def leaf(rows: np.ndarray, who: np.ndarray) -> None:
            self.visits += len(rows) * len(who)
            product = queries[who] @ self.matrix[rows].T
            product[asked[who][:, None] == self.ids[rows][None, :]] = -np.inf
            useful = (product >= (worst[who] - SLACK * (1 + np.abs(worst[who])))[:, None]) & (product > -np.inf)
            some = np.flatnonzero(useful.any(axis=1))
            if not len(some):
                return
            merged = np.concatenate([top[who[some]], product[some]], axis=1)
            top[who[some]] = merged = np.partition(merged, -k, axis=1)[:, -k:]
            worst[who[some]] = np.maximum(worst[who[some]], merged[:, 0])
            at, column = np.nonzero(useful[some] & (product[some] >= (worst[who[some]] - SLACK * (1 + np.abs(worst[who[some]])))[:, None]))
            found.append((who[some[at]], rows[column]))

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if isinstance(node, np.ndarray):
                leaf(node, who)
                return
            vantage, split, (near, far) = node
            away = distance(points[who], vantage)
            inside = away <= split
            visit(near[0], who[inside])  # first the side where the query is
            visit(far[0], who[~inside])
            for (child, low, high), other in ((far, inside), (near, ~inside)):
                rest = who[other]
                radius = np.sqrt(np.maximum(offset[rest] - 2 * worst[rest], 0))
                visit(child, rest[self.factor * gap(away[other], low, high) <= radius])

        visit(self.root, np.arange(len(queries)))
        number, rows = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*found, strict=True)) or [(), ()]))
        score = (queries[number] * self.matrix[rows]).sum(axis=1)  # always in the same order, so equal vectors tie
        chosen = best(number, self.ids[rows], score, k)
        return number[chosen], self.ids[rows[chosen]], score[chosen]


class Shards:
    """A vantage-point tree over a sample, whose leaves are the shards of all vectors of one width."""

    def __init__(self, sample: np.ndarray, length: float, count: int):
        self.length = length
        self.vantage: list[np.ndarray] = []
        self.split: list[float] = []
        self.child: list[list[int]] = []  # of each split its two sides: a split, or a shard as ~number
        open_leaves = [(len(sample), [], self.lifted(sample))]
        while len(open_leaves) < count:
            open_leaves.sort(key=lambda x: -x[0])
            size, path, points = open_leaves[0]
            if size < 2:
                break
            vantage = vantage_point(points)
            away = distance(points, vantage)
            split = float(np.median(away))
            if not (away > split).any():
                break
            self.vantage.append(vantage)
            self.split.append(split)
            self.child.append([0, 0])
            if path:
                self.child[path[-1][0]][path[-1][1]] = len(self.split) - 1
            sides = (points[away <= split], points[away > split])
            open_leaves[:1] = [(len(p), [*path, (len(self.split) - 1, side)], p) for side, p in enumerate(sides)]
        self.paths = [path for _, path, _ in open_leaves]  # for each shard, its (split, side) from the top
        for shard, path in enumerate(self.paths):
            if path:
                self.child[path[-1][0]][path[-1][1]] = ~shard

    def lifted(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors with the component that gives them the same length; a query has a zero there."""
        last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.length - (vectors**2).sum(axis=1), 0))
        return np.column_stack([vectors, last])

    def away(self, points: np.ndarray) -> np.ndarray:
        """Distances of points from all vantage points."""
        return np.stack([distance(points, v) for v in self.vantage], axis=1) if self.vantage else np.zeros((len(points), 0))

    def home(self, away: np.ndarray) -> np.ndarray:
        """The shard of each point."""
        if not self.split:
            return np.zeros(len(away), np.int64)
        at, split, child = np.zeros(len(away), np.int64), np.array(self.split), np.array(self.child)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = child[node, (away[inner, node] > split[node]).astype(int)]
        return ~at

    def gaps(self, away: np.ndarray, ranges: dict[tuple[int, int], tuple[float, float]]) -> np.ndarray:
        """For each point and shard, the least distance that the triangle inequality allows; infinite for empty shards."""
        out = np.full((len(away), len(self.paths)), np.inf)
        for shard, path in enumerate(self.paths):
            if (shard, -1) in ranges:
                out[:, shard] = 0
                for split, _ in path:
                    out[:, shard] = np.maximum(out[:, shard], gap(away[:, split], *ranges[shard, split]))
        return out


def fit_shards(vectors: DataFrame, block_rows: int, sample_rows: int) -> dict[int, Shards]:
    """For each width the shards, from a random sample of about ``sample_rows`` vectors."""
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sizes = {r.width: (r.n, r.length) for r in vectors.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(length).alias("length")).collect()}
    total = sum(n for n, _ in sizes.values())
    by_width = defaultdict(list)
    for r in vectors.select("v").sample(min(1.0, sample_rows / max(1, total)), seed=9).limit(2 * sample_rows).collect():
        by_width[len(r.v)].append(r.v)
    return {
        w: Shards(np.array(by_width[w], float).reshape(-1, w), longest * (1 + 1e-12), min(MAX_SHARDS, math.ceil(n / block_rows)))
        for w, (n, longest) in sizes.items()
    }


def _by_width(vectors: list[list[float]]):
    own = defaultdict(list)
    for i, v in enumerate(vectors):
        own[len(v)].append(i)
    return ((w, i, np.array([vectors[j] for j in i], float)) for w, i in own.items())


def deal(vectors: DataFrame, model) -> DataFrame:
    """(shard, width, vec_id, v, limit) of all rows."""

    def run(batches):
        for ids, values in batches:
            for width, at, matrix in _by_width(values):
                shards = model.value[width]
                yield [shards.home(shards.away(shards.lifted(matrix))), [width] * len(at), [ids[i] for i in at], [values[i] for i in at], [-np.inf] * len(at)]

    return map_rows(vectors, run, "shard int, width int, vec_id long, v array<double>, limit double")


def shard_ranges(dealt: DataFrame, model) -> dict[int, dict]:
    """For each width: the range of distances of the rows of each shard from each vantage point above it; one row each."""

    def run(batches):
        for shard, width, values in batches:
            by_shard = defaultdict(list)
            for s, w, v in zip(shard, width, values, strict=True):
                by_shard[w, s].append(v)
            for (w, s), own in by_shard.items():
                shards = model.value[w]
                points = shards.lifted(np.array(own, float))
                splits = [split for split, _ in shards.paths[s]]
                away = [distance(points, shards.vantage[split]) for split in splits]
                n = len(splits) + 1
                yield [[w] * n, [s] * n, [-1, *splits], [0.0, *(a.min() for a in away)], [0.0, *(a.max() for a in away)]]

    found = map_rows(dealt.select("shard", "width", "v"), run, "width int, shard int, split int, low double, high double")
    out: dict[int, dict] = defaultdict(dict)
    for r in found.groupBy("width", "shard", "split").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        out[r.width][r.shard, r.split] = (r.low, r.high)
    return out


def route(queries: DataFrame, model, ranges, factor: float | None, home: bool) -> DataFrame:
    """(shard, width, vec_id, v, limit): each query with its home shard, or with the others that ``limit`` leaves open."""

    def run(batches):
        for ids, values, limits in batches:
            for width, at, matrix in _by_width(values):
                if width not in model.value:
                    continue
                shards = model.value[width]
                away = shards.away(shards.lifted(matrix, query=True))
                gaps = shards.gaps(away, ranges.value[width])
                # The nearest by the ranges; of equally near ones that on whose side of all splits the query is.
                own = shards.home(away)
                own = np.where(np.isfinite(gaps[np.arange(len(own)), own]), own, np.argmin(gaps, axis=1))
                if home:
                    who, where = np.arange(len(at)), own
                else:
                    limit = np.array([limits[i] for i in at], float)
                    radius = np.sqrt(np.maximum((matrix**2).sum(axis=1) + shards.length - 2 * limit, 0))
                    open_ = np.isfinite(gaps) & (factor_for(width, factor) * gaps <= radius[:, None])
                    open_[np.arange(len(own)), own] = False
                    who, where = np.nonzero(open_)
                who = [at[i] for i in who.tolist()]
                yield [where, [width] * len(who), [ids[i] for i in who], [values[i] for i in who], [limits[i] for i in who]]

    return map_rows(queries.select("vec_id", "v", "limit"), run, "shard int, width int, vec_id long, v array<double>, limit double")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float | None = None, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score double): found among (vec_id, v) rows, nearest first.

    Every row is in a tree; ``factor``, by default one that suits the number of components, only decides how many shards,
    and leaves in them, are visited. A row is never its own answer; rows that share a query's id are its own too, and of queries with one id the
    smallest vector counts. Scores are inner products of the original vectors in doubles. No rows, no results.
    """
    spark = vectors.sparkSession
    model = spark.sparkContext.broadcast(fit_shards(vectors, block_rows, sample_rows))
    dealt = cut_lineage(deal(vectors, model))
    ranges = spark.sparkContext.broadcast(shard_ranges(dealt, model))
    blocks = cut_lineage(pack(dealt, block_rows))
    find = partial(VantageTree, factor=factor)
    asked = cut_lineage(one_per_id(queries).withColumn("limit", F.lit(float("-inf"))))
    first = cut_lineage(meet(blocks, pack(route(asked, model, ranges, factor, True), QUERY_ROWS), find, k, "double"))
    # What a query has reached at home: its k-th best there, if there are so many.
    reached = ranked(first, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached"))
    going_on = asked.join(reached, "vec_id", "left").withColumn("limit", F.coalesce("reached", "limit"))
    more = meet(blocks, pack(route(going_on, model, ranges, factor, False), QUERY_ROWS), find, k, "double")
    return ranked(first.unionByName(more), k)
