"""MinHash signatures and their bands."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import words

PRIME = 2_147_483_647
PERMUTATIONS = 128
# The split of 128 permutations with the least error around Jaccard 0.8.
BANDS, ROWS = 9, 13


def coefficients(k: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Multiplier and offset of permutation i, drawn from the MD5 of its name."""
    draw = lambda name: int(hashlib.md5(name.encode()).hexdigest()[:8], 16)
    a = [draw(f"a{i}") % (PRIME - 1) + 1 for i in range(k)]
    b = [draw(f"b{i}") % PRIME for i in range(k)]
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def word_hashes(text: Column) -> Column:
    """One 31-bit hash per distinct word."""
    return F.transform(
        F.array_distinct(words(text)),
        lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % F.lit(PRIME),
    )


def _signature_udf(k: int):
    a, b = coefficients(k)

    @F.arrow_udf("array<bigint>")
    def signature(hashes: pa.Array) -> pa.Array:
        sizes = np.asarray(hashes.value_lengths().fill_null(0), dtype=np.int64)
        values = np.asarray(hashes.flatten(), dtype=np.int64)
        out = np.full((len(sizes), k), PRIME, dtype=np.int64)
        filled = sizes > 0
        if filled.any():
            starts = (np.cumsum(sizes) - sizes)[filled]
            for i in range(k):
                out[filled, i] = np.minimum.reduceat((values * a[i] + b[i]) % PRIME, starts)
        ends = np.arange(0, out.size + 1, k, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return signature


def minhash_signature(text: Column, k: int = PERMUTATIONS) -> Column:
    """Least permuted hash per permutation; an empty text has ``PRIME`` in every slot.

    Words are split and hashed in the JVM. Only the integers cross to Python,
    where whole Arrow batches are permuted with numpy.
    """
    return _signature_udf(k)(word_hashes(text))


def band_keys(signature: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """One 128-bit key per band; two texts collide when they share a key."""
    return F.array(*[
        F.unhex(F.md5(F.concat_ws(":", F.lit(str(i)), F.array_join(F.slice(signature, i * rows + 1, rows), ","))))
        for i in range(bands)
    ])
