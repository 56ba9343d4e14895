"""Periodic runs of words by block convolution (operator 13).

A run is a longest stretch of words with smallest period q that is at least
four periods long. For q between B and 2B, B a power of two, the first block
of B words at a multiple of B inside the run occurs again q words later. So at
each such scale every block is slid over the words that follow it, and the sum
of squared differences is taken at all distances from B to 2B at once, by a
number-theoretic transform in whole numbers. A sum of zero is an occurrence,
and its distance seeds an extension to both sides.

Blocks are passed by only where no run can be lost: where some word does not
come again within 2B words, or where the block and its window lie in a run of
smaller period, whose multiples are no smallest periods.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.tasks import map_rows

PERIODS = 4  # a run has at least so many periods
LEAST = 6  # and so many words
GROUP_BYTES = 4 << 20  # texts looked at together, unless one alone is longer
CELLS = 1 << 20  # numbers transformed at once
# Primes with 3 as a generator. Sums below their product are told from zero exactly.
PRIMES = (998244353, 469762049)
FAR = np.int64(1) << 60
RUNS = "array<struct<start: long, length: long, period: long>>"


def powers(p: int, length: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a ``length``-th root of one modulo ``p``."""
    root = pow(3, (p - 1) // length, p)
    root = pow(root, -1, p) if inverse else root
    out = np.ones(max(1, length // 2), np.uint64)
    have = 1
    while have < len(out):
        out[have : 2 * have] = out[:have] * np.uint64(pow(root, have, p)) % np.uint64(p)
        have *= 2
    return out


def transform(rows: np.ndarray, p: int) -> np.ndarray:
    """Number-theoretic transform of each row; places come in bit-reversed order."""
    prime, (count, length) = np.uint64(p), rows.shape
    root = powers(p, length, False)
    half = length // 2
    while half:
        pairs = rows.reshape(count, -1, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        rows = np.stack([(low + high) % prime, (low + prime - high) * root[:: length // (2 * half)] % prime], axis=2).reshape(count, length)
        half //= 2
    return rows


def back(rows: np.ndarray, p: int) -> np.ndarray:
    """The inverse of ``transform``."""
    prime, (count, length) = np.uint64(p), rows.shape
    root = powers(p, length, True)
    half = 1
    while half < length:
        pairs = rows.reshape(count, -1, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1] * root[:: length // (2 * half)] % prime
        rows = np.stack([(low + high) % prime, (low + prime - high) % prime], axis=2).reshape(count, length)
        half *= 2
    return rows * np.uint64(pow(length, -1, p)) % prime


def occurrences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For rows of B and of 2B numbers: whether the block equals the window at offset j, for each j below B."""
    count, size = blocks.shape
    # Words are renamed per block, from one up, and what the block does not have is zero: so sums stay small.
    rows = np.arange(count, dtype=np.int64)[:, None] * (max(int(blocks.max()), int(windows.max())) + 1)
    names, inside = np.unique(blocks + rows, return_inverse=True)
    inside = inside.reshape(blocks.shape)
    first = inside.min(axis=1, keepdims=True)
    left = (inside - first + 1).astype(np.uint64)
    wanted = windows + rows
    found = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    right = np.where(names[found] == wanted, found - first + 1, 0).astype(np.uint64)
    ahead = np.concatenate([np.zeros((count, 1), np.uint64), np.cumsum(right * right, axis=1, dtype=np.uint64)], axis=1)
    squares = (left * left).sum(axis=1, keepdims=True, dtype=np.uint64) + ahead[:, size : 2 * size] - ahead[:, :size]
    padded = np.concatenate([left[:, ::-1], np.zeros_like(left)], axis=1)
    zero = np.ones((count, size), bool)
    for p in PRIMES:
        prime = np.uint64(p)
        products = back(transform(padded % prime, p) * transform(right % prime, p) % prime, p)
        zero &= (squares + (prime - products[:, size - 1 : 2 * size - 1]) * np.uint64(2)) % prime == 0
    return zero


def stretch(x: np.ndarray, at: int, size: int, d: int) -> tuple[int, int]:
    """The longest stretch of period ``d`` around a block that occurs again ``d`` later; empty if it does not."""
    if not np.array_equal(x[at : at + size], x[at + d : at + d + size]):
        return at, at
    start, stop, step = at, at + size, 16
    while start:
        low = max(0, start - step)
        differ = np.flatnonzero(x[low:start] != x[low + d : start + d])
        start = low + int(differ[-1]) + 1 if len(differ) else low
        if len(differ):
            break
        step *= 2
    step, end = 16, len(x) - d
    while stop < end:
        high = min(end, stop + step)
        differ = np.flatnonzero(x[stop:high] != x[stop + d : high + d])
        stop = stop + int(differ[0]) if len(differ) else high
        if len(differ):
            break
        step *= 2
    return start, stop + d


def stretches(x: np.ndarray, seeds: np.ndarray, size: int, d: int) -> list[tuple[int, int]]:
    """The stretches of period ``d`` around blocks at ``seeds``, ascending; each once."""
    if len(seeds) > 64:  # all at once
        edge = np.diff(np.concatenate([[False], x[:-d] == x[d:], [False]]).astype(np.int8))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        own = np.unique(np.searchsorted(starts, seeds, side="right") - 1)
        return [(int(s), int(e) + d) for s, e in zip(starts[own], stops[own], strict=True)]
    found, i = [], 0
    while i < len(seeds):
        start, stop = stretch(x, int(seeds[i]), size, d)
        found.append((start, stop))
        i = max(i + 1, int(np.searchsorted(seeds, stop - d - size, side="right")))
    return found


def runs_of(x: np.ndarray, ends: np.ndarray, periods: int = PERIODS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, stop, period) of all runs in numbers ``x``; ``ends`` are the places of numbers that occur only once.

    These set texts apart, so no run reaches over them; the last number is one of them.
    """
    if periods < 4:
        raise ValueError("a block and its next occurrence need runs of four periods or more")
    n = len(x)
    order = np.argsort(x, kind="stable")
    again = np.full(n, FAR)  # how far it is to the next one of its kind
    same = x[order[1:]] == x[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    end_of = ends[np.searchsorted(ends, np.arange(n))]
    longest = int(np.diff(ends, prepend=-1).max()) - 1
    cover, runs, size = np.zeros(n, np.int64), [], 1
    while size <= longest // periods:
        starts = np.arange(len(again)) * size
        window_end = np.minimum(starts + 3 * size, end_of[np.minimum(starts, n - 1)])
        alive = starts[(again < 2 * size) & (cover[np.minimum(starts, n - 1)] < window_end)]
        seeds: dict[int, list[np.ndarray]] = defaultdict(list)
        step = max(1, CELLS // (2 * size))
        padded = np.concatenate([x, np.full(3 * size, x[-1])])
        for i in range(0, len(alive), step):
            at = alive[i : i + step]
            zero = occurrences(padded[at[:, None] + np.arange(size)], padded[at[:, None] + size + np.arange(2 * size)])
            row, offset = np.nonzero(zero)
            block, d = at[row], offset + size
            new = (cover[block] < block + d + size) & (block + d + size <= n)
            for one in np.unique(d[new]):
                seeds[int(one)].append(block[new & (d == one)])
        for d in sorted(seeds):
            for start, stop in stretches(x, np.concatenate(seeds[d]), size, d):
                if stop - start >= max(least, periods * d) and cover[start] < stop:
                    runs.append((start, stop, d))
                    np.maximum(cover[start:stop], stop, out=cover[start:stop])
        again = np.concatenate([again, np.full(len(again) % 2, FAR)]).reshape(-1, 2).max(axis=1)
        size *= 2
    return runs


def _look(names: list, texts: list[bytes | None], rewrite, periods: int, least: int) -> list[list]:
    """Columns of the result for some texts."""
    words = [(t or b"").split() for t in texts]
    if rewrite is not None:
        words = [rewrite(name, w) for name, w in zip(names, words, strict=True)]
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    x = np.empty(int(ends[-1]) + 1, np.int64)
    for w, end in zip(words, ends.tolist(), strict=True):
        x[end - len(w) : end] = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
    x[ends] = len(number) + np.arange(len(ends))
    found = defaultdict(list)
    for start, stop, period in sorted(runs_of(x, ends, periods, least), key=lambda r: (r[0], r[2])):
        text = int(np.searchsorted(ends, start))
        found[text].append((start - int(ends[text]) + len(words[text]), stop - start, period))
    runs, best, left = [], [], []
    for i, w in enumerate(words):
        own = found.get(i, [])
        runs.append(own)
        # The first of the greatest: runs are in order of start and period.
        best.append(max(own, key=lambda r: Fraction(r[1], r[2])) if own else (None, None, None))
        if own:
            keep = np.ones(len(w), bool)
            for start, length, period in own:
                keep[start + period : start + length] = False
            w = [x for x, k in zip(w, keep.tolist(), strict=True) if k]
        left.append(b" ".join(w))
    return [names, [len(r) for r in runs], *map(list, zip(*best, strict=True)), runs, left]


def periodic_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", periods: int = PERIODS, least: int = LEAST,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs, collapsed) of every row of ``docs``.

    Words are set apart by white space, and numbered from 0. ``runs`` has
    (start, length, period) of all runs by start, then period. ``start``,
    ``length`` and ``period`` are of the run with the greatest length/period,
    of equal ones the first; null without a run. ``collapsed`` is the text with
    each run cut down to its first period. ``rewrite(doc_id, words)`` may give
    other words to look at.

    Whole texts are searched, by a method whose cost does not depend on the
    text's kind. A null, empty or blank text has no words and no runs.
    Repeated rows, and rows without an id, each get their row. An empty table gives no rows.
    """

    def run(batches):
        for names, texts in batches:
            start, held = 0, 0
            for i, t in enumerate(texts):
                held += len(t or b"")
                if held > GROUP_BYTES and i > start:
                    yield _look(names[start:i], texts[start:i], rewrite, periods, least)
                    start, held = i, len(t or b"")
            if texts:
                yield _look(names[start:], texts[start:], rewrite, periods, least)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    found = map_rows(rows, run, f"doc_id long, n_runs long, start long, length long, period long, runs {RUNS}, collapsed binary")
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        "runs", F.col("collapsed").cast("string").alias("collapsed"),
    )
