"""Near-duplicate vectors by product quantisation (operator 12).

Vectors are scaled to length one and filed under the nearest of a number of
coarse centres. What is left after its centre is taken off is cut into subspaces,
each coded by the nearest of 256 words, and the length of the error is kept.
A vector is compared with a list if the plane halfway between the list's centre and its own
is no farther than two linked vectors can be apart: no linked vector can lie
in any other list. In a list, distances are read from tables of one row per
subspace; codes nearer than the limit and their error allow are compared
exactly. With all these lists, centres and words, fitted on a bounded sample, decide how much is compared, never what is found.

Two vectors would have to differ along the line between two centres alone to
need the farthest of these lists. Differences in no special direction have along one line a
deviation of their length by the root of the number of components, and ``DEVIATIONS`` of these
are enough for practically all links; None compares with every list.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.tasks import map_rows
from tidewire.llm.vectors import usable
from tidewire.operators.components import components
from tidewire.session import cut_lineage

COSINE = 0.95
SAMPLE_ROWS = 8192  # vectors that centres and words are fitted on
DEVIATIONS = 4.0
LIST_ROWS = 256  # vectors per list aimed at, until there are ...
MAX_LISTS = 4096  # ... so many lists: bounds what each task is sent
SUBSPACES = 8
WORDS = 256
STEPS = 6
PIECE_ROWS = 2048  # entries of a list that are held at once
ASKED_ROWS = 8192  # vectors compared with a piece in one task
TURN_ROWS = 256
EXACT_PAIRS = 16_384
ENTRY = "width int, list int, node long, n long, kind byte, codes binary, error double, vector binary"


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point."""
    if len(centres) == 1:
        return np.zeros(len(points), np.int64)
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


def k_means(points: np.ndarray, k: int, steps: int = STEPS) -> np.ndarray:
    """Up to ``k`` centres; without points, one at the origin. The same points give the same centres."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    centres = points[:: max(1, len(points) // k)][:k].copy()
    for _ in range(steps):
        own = nearest(points, centres)
        order = np.argsort(own, kind="stable")
        used, start = np.unique(own[order], return_index=True)
        centres[used] = np.add.reduceat(points[order], start, axis=0) / np.diff(np.append(start, len(own)))[:, None]
    return np.unique(centres, axis=0)


class Quantiser:
    """Centres of the lists and words of the subspaces, for vectors of one width and length one."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES):
        self.centres = k_means(sample, lists)
        left = sample - self.centres[nearest(sample, self.centres)]
        width = sample.shape[1]
        self.edges = [width * i // subspaces for i in range(subspaces + 1)]
        self.words = [k_means(left[:, a:b], WORDS) for a, b in self.spans()]
        self.between = np.sqrt(np.maximum(((self.centres[:, None] - self.centres[None]) ** 2).sum(axis=2), 1e-300)) if len(self.centres) <= 512 else None

    def spans(self):
        return zip(self.edges[:-1], self.edges[1:], strict=True)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of the error) of each vector."""
        own = nearest(vectors, self.centres)
        left = vectors - self.centres[own]
        codes = np.stack([nearest(left[:, a:b], w) for (a, b), w in zip(self.spans(), self.words, strict=True)], axis=1)
        said = np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)
        return own, codes.astype(np.uint8), np.sqrt(((left - said) ** 2).sum(axis=1))

    def probes(self, vectors: np.ndarray, own: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list): lists after its own that may hold something within ``far``.

        If something nearer to centre c than to the own centre o is within ``far`` of
        x, the plane between both centres is: (|x-c|^2 - |x-o|^2) / (2 |c-o|) <= far. Lists before the own
        one are left out, as their vectors ask for this one.
        """
        square = (self.centres**2).sum(axis=1) - 2 * vectors @ self.centres.T
        gap = square - square[np.arange(len(own)), own][:, None]
        apart = self.between[own] if self.between is not None else np.sqrt(np.maximum(
            (self.centres**2).sum(axis=1) + (self.centres[own] ** 2).sum(axis=1)[:, None] - 2 * self.centres[own] @ self.centres.T, 1e-300))
        return np.nonzero((gap <= 2 * far * apart + 1e-9) & (np.arange(len(self.centres)) > own[:, None]))

    def tables(self, vectors: np.ndarray, place: int) -> list[np.ndarray]:
        """For each subspace the squared distances of ``vectors``, less a list's centre, to its words."""
        left = vectors - self.centres[place]
        return [((left[:, a:b] ** 2).sum(axis=1)[:, None] + (w**2).sum(axis=1) - 2 * left[:, a:b] @ w.T).astype(np.float32) for (a, b), w in zip(self.spans(), self.words, strict=True)]


def fit(rows: DataFrame, lists: int | None = None, sample_rows: int = SAMPLE_ROWS) -> dict[int, Quantiser]:
    """A quantiser for each width in a random sample of about ``sample_rows`` vectors."""
    count = rows.count()
    lists = lists or min(MAX_LISTS, max(1, count // LIST_ROWS))
    sample = rows.select("v").sample(min(1.0, sample_rows / max(1, count)), seed=3).limit(2 * sample_rows).collect()
    by_width = defaultdict(list)
    for r in sample:
        by_width[len(r.v)].append(r.v)
    return {w: Quantiser(unit(np.array(v, float)), min(lists, max(1, len(v) // 8))) for w, v in by_width.items()}


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; first scaled by their largest part, so that squares neither vanish nor overflow."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def _quantiser(model, width: int) -> Quantiser:
    """That of a width, or, if the sample has none of it, one with a single list and empty codes."""
    own = model.value
    if width not in own:
        own[width] = Quantiser(np.empty((0, width)), 1)
    return own[width]


def reach(far: float, width: int, deviations: float | None) -> float:
    """How near the plane between two centres must be, for vectors within ``far`` of each other."""
    return far if deviations is None else far * min(1.0, deviations / math.sqrt(width))


def enter(rows: DataFrame, model, far: float, deviations: float | None = None) -> DataFrame:
    """The entries of all lists (kind 0) and what else each list is asked for (kind 1, without the vector), from (node, n, v)."""

    def run(batches):
        for nodes, counts, vectors in batches:
            by_width = defaultdict(list)
            for i, v in enumerate(vectors):
                by_width[len(v)].append(i)
            for width, at in by_width.items():
                q = _quantiser(model, width)
                x = unit(np.array([vectors[i] for i in at], float))
                own, codes, error = q.encode(x)
                blobs, node, n = [v.tobytes() for v in x], [nodes[i] for i in at], [counts[i] for i in at]
                yield [[width] * len(at), own.tolist(), node, n, [0] * len(at), [c.tobytes() for c in codes], error.tolist(), blobs]
                who, where = q.probes(x, own, reach(far, width, deviations))
                who = who.tolist()
                yield [[width] * len(who), where.tolist(), [node[i] for i in who], [n[i] for i in who], [1] * len(who), *[[None] * len(who)] * 3]

    return map_rows(rows, run, ENTRY)


def _linked(q: Quantiser, place: int, held: dict, asked: dict, cosine: float, far: float, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(asked, held) of all linked pairs; with ``inside`` both are of this list and each pair is looked at once."""
    tables = q.tables(asked["vector"], place)
    square = tables[0][:, held["codes"][:, 0]]
    for i in range(1, len(tables)):
        square += tables[i][:, held["codes"][:, i]]
    near = square <= ((far + held["error"]) ** 2 + 1e-4).astype(np.float32)
    if inside:
        near &= asked["node"][:, None] < held["node"][None]
    one, two = np.nonzero(near)
    keep = [np.empty(0, bool)]
    for i in range(0, len(one), EXACT_PAIRS):
        keep.append((asked["vector"][one[i : i + EXACT_PAIRS]] * held["vector"][two[i : i + EXACT_PAIRS]]).sum(axis=1) >= cosine)
    keep = np.concatenate(keep)
    return one[keep], two[keep]


def _counts(held: dict, asked: dict, one: np.ndarray, two: np.ndarray) -> list[list]:
    """(node, links, low): links of each node, and a lower node it is connected with, if any, both among these pairs."""
    nodes = np.concatenate([asked["node"], held["node"]])
    two = two + len(asked["node"])
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, one, held["n"][two - len(asked["node"])])
    np.add.at(links, two, asked["n"][one])
    low = nodes.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, one, low[two])
        np.minimum.at(low, two, low[one])
        if np.array_equal(before, low):
            break
    met = np.flatnonzero(links)
    return [nodes[met].tolist(), links[met].tolist(), [a if a < b else None for a, b in zip(low[met].tolist(), nodes[met].tolist(), strict=True)]]


def meet(entries: DataFrame, model, cosine: float, far: float) -> DataFrame:
    """(node, links, low): the links found in each list, as sums and stars instead of pairs.

    A list is cut into pieces, and those who ask into slices; each piece meets each slice in a group of its own.
    """
    sizes = entries.groupBy("width", "list").agg(
        F.count(F.when(F.col("kind") == 0, 1)).alias("held"), F.count("*").alias("asked"))
    # One row per list: bounded by the number of lists and widths.
    sizes = sizes.select("width", "list", F.ceil(F.col("held") / PIECE_ROWS).cast("int").alias("pieces"), F.ceil(F.col("asked") / ASKED_ROWS).cast("int").alias("slices"))
    cut = entries.drop("vector").join(sizes, ["width", "list"]).filter("pieces > 0")
    own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    turn = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("slices")).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    held = cut.filter("kind = 0").withColumn("piece", own).withColumn("slice", F.explode(span("slices")))
    asked = cut.withColumn("slice", turn).withColumn("piece", F.explode(span("pieces")))
    # Who is of the list asks as kind 1, who is not as kind 2; both after the entries.
    both = held.unionByName(asked.withColumn("kind", F.col("kind") + F.lit(1).cast("byte")))
    both = both.join(entries.filter("kind = 0").select("node", "vector"), "node")
    keys = ["width", "list", "piece", "slice"]
    shuffles = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.select(*keys, "kind", "node", "n", "codes", "error", "vector").repartition(shuffles, *keys).sortWithinPartitions(*keys, "kind")

    def arrays(rows, width, codes):
        out = {"node": np.array([r[0] for r in rows], np.int64), "n": np.array([r[1] for r in rows], np.int64),
               "vector": np.frombuffer(b"".join(r[4] for r in rows)).reshape(-1, width)}
        if codes:
            out |= {"codes": np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1), "error": np.array([r[3] for r in rows])}
        return out

    def run(batches):
        at, kind_at, rows, held = None, None, [], None

        def answer():
            q, asked = _quantiser(model, at[0]), arrays(rows, at[0], False)
            one, two = _linked(q, at[1], held, asked, cosine, far, kind_at == 1)
            return _counts(held, asked, one, two) if len(one) else None

        def close():
            nonlocal held
            if not rows:
                return None
            if kind_at == 0:
                held = arrays(rows, at[0], True)
                return None
            return answer() if held is not None else None

        for row in (r for b in batches for r in zip(*b, strict=True)):
            key, kind = row[:4], row[4]
            if key != at or kind != kind_at or (kind and len(rows) >= TURN_ROWS):
                if (found := close()) is not None:
                    yield found
                held = held if key == at else None
                at, kind_at, rows = key, kind, []
            rows.append(row[5:])
        if (found := close()) is not None:
            yield found

    return map_rows(dealt, run, "node long, links long, low long")


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
    lists: int | None = None, sample_rows: int = SAMPLE_ROWS, deviations: float | None = DEVIATIONS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): every row of ``vectors`` with its class of near copies.

    Rows link if their cosine, in doubles, is at least ``cosine`` and they have the same number of components.
    ``n_links`` counts the other rows linked directly, equal ones among them, ``component_id`` is the smallest id
    reached over links, the own included, and ``kept`` tells the rows that have it.
    Pairs no farther apart than ``deviations`` divided by the root of the number of components, times the largest distance
    of a link, are all found, others unless they differ along the line between two centres; None finds all.
    Equal vectors are looked at once and count as often as they occur. A vector that is null, empty or zero, or holds
    null or non-finite components, links with nothing, and neither does a row without an id; its component is its own id.
    Rows that repeat an id are rows of their own. An empty table gives no rows.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0, and at most 1")
    spark = vectors.sparkSession
    far = math.sqrt(2 - 2 * cosine) + 1e-9
    good = usable(vectors, vec_id, embedding, zero=False)
    folded = good.groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    folded = cut_lineage(folded.select(F.monotonically_increasing_id().alias("node"), "n", "least", "v"))
    model = spark.sparkContext.broadcast(fit(folded, lists, sample_rows))
    entries = cut_lineage(enter(folded.select("node", "n", "v"), model, far, deviations))
    found = cut_lineage(meet(entries, model, cosine, far))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    stars = components(found.filter("low IS NOT NULL").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct())
    labelled = folded.drop("v").join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(ids, "component").join(links, "node", "left")
    named = named.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    classes = folded.select("node", "v").join(named, "node").drop("node")
    linked = good.join(classes, "v").select("vec_id", "n_links", "component_id")
    v = F.col(embedding).cast("array<double>")
    none = F.col(vec_id).isNull() | v.isNull() | (F.size(v) == 0) | ~F.exists(v, lambda x: x != 0)
    none = none | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    alone = vectors.filter(F.coalesce(none, F.lit(True))).select(F.col(vec_id).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"))
    both = linked.unionByName(alone.withColumn("component_id", F.col("vec_id")))
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
