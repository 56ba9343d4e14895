"""Exact top-k search by MaxScore over signed integer vectors (operator 7).

Each component is a term with one posting per row. For a query, a term's
bound is the most it can add to any row's score within a shard. Terms are
taken by falling bound: while the bounds of the rest could still lift an
unseen row over the k-th best score known, a term is essential and its
postings are traversed for all rows; the others are probed in turn, only for the rows that stay competitive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.vectors import best, search, usable

SCALE = 64
PROBE = 8  # terms probed between two looks at who is still competitive
SEED_ROWS = 512  # rows scored in full first, for a first threshold


def quantize(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the usable vectors, the all-zero ones included."""
    rows = usable(vectors, vec_id, embedding, zero=True)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


class MaxScore:
    """Postings of one shard: for each term, the values of all rows, and their extremes."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.terms = ids[order], np.ascontiguousarray(matrix[order].T)
        self.low, self.high = self.terms.min(axis=1), self.terms.max(axis=1)

    def __call__(self, asked: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int):
        """Each query's k best rows other than its own. Sums of whole numbers below 2**53 are exact in doubles."""
        numbers, found, scores = [], [], []
        for i, (own, query) in enumerate(zip(asked, queries, strict=True)):
            at, score = self.query(own, query, k)
            numbers.append(np.full(len(at), i))
            found.append(self.ids[at])
            scores.append(score)
        return np.concatenate(numbers), np.concatenate(found), np.concatenate(scores).astype(np.int64)

    def query(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.maximum(query * self.low, query * self.high)
        terms = np.argsort(-bounds, kind="stable")
        rest = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0.0)  # what the terms from here on can add
        weights = query[terms]
        seed = np.flatnonzero(self.ids[: SEED_ROWS + k] != own)
        first = query @ self.terms[:, seed]
        limit = np.partition(first, -k)[-k] if len(seed) >= k else -np.inf
        essential = int(np.argmax(rest < limit)) if (rest < limit).any() else len(terms)
        score = weights[:essential] @ self.terms[terms[:essential]]
        rows = np.flatnonzero((score + rest[essential] >= limit) & (self.ids != own))
        score = score[rows]
        for start in range(essential, len(terms), PROBE):
            stop = min(start + PROBE, len(terms))
            score = score + weights[start:stop] @ self.terms[terms[start:stop, None], rows]
            competitive = score + rest[stop] >= limit
            rows, score = rows[competitive], score[competitive]
            if len(rows) > 4 * k:  # rows have at least this score if all that remains goes against them
                worst = np.minimum(query * self.low, query * self.high)[terms[stop:]].sum()
                limit = max(limit, np.partition(score, -k)[-k] + worst)
        keep = best(np.zeros(len(rows), int), self.ids[rows], score, k)
        return rows[keep], score[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score long): exact, over (vec_id, v) rows of whole numbers as doubles.

    A row is never its own answer; rows that share a query's id are its own too, and of queries with one id the smallest vector counts.
    With fewer rows than ``k``, all are returned. No rows, no results.
    """
    return search(vectors, queries, MaxScore, k, "long")
