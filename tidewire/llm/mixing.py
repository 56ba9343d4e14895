"""Mixing sources to target weights by temperature (operator 3).

A source's weight is its share of the tokens raised to an exponent and
normalised. Exponent 1 keeps the natural shares, 0 makes all sources equal.
The exponent is the one nearest to 1 that reaches a target entropy, or the
one nearest to 0 that repeats no source more often than allowed. Each source
then gets its part of the token budget in whole and part passes over its
documents, spread evenly over blocks, and each block is put in an order of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.ranks import running_sum, slices_for
from tidewire.session import cut_lineage

BLOCK_TOKENS = 1 << 18
SECTIONS = 32  # parts into which a step divides the interval, as five bisections would
STEPS = 6


@dataclass
class Mix:
    """A chosen exponent: weights are ``share ** exponent / norm``; ``budget`` is in tokens."""

    exponent: float
    norm: float
    entropy: float
    budget: float


def source_tokens(docs: DataFrame, source: str, tokens: str) -> DataFrame:
    """(source, tokens, share, rows): what there is of each source."""
    sums = cut_lineage(docs.groupBy(F.col(source).alias("source")).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("rows")))
    total = sums.agg(F.sum("tokens")).first()[0] or 1
    return sums.withColumn("share", F.col("tokens") / F.lit(total))


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent: the norm and the entropy of the weights, summed over all sources in one pass."""
    columns = []
    for i, x in enumerate(exponents):
        power = F.pow("share", F.lit(x))
        columns += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log("share")).alias(f"w{i}")]
    r = shares.agg(*columns).first()
    return [(r[f"z{i}"], math.log(r[f"z{i}"]) - x * r[f"w{i}"] / r[f"z{i}"]) for i, x in enumerate(exponents)]


def choose_exponent(
    shares: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None,
) -> Mix:
    """Solve for the exponent in [0, 1]. ``target_entropy`` is in nats.

    Without ``budget`` it is the smallest one at which every source is seen in
    full at least once. With both goals the repetition limit goes first.
    """
    least, most, total = shares.agg(F.min("share"), F.max("share"), F.sum("tokens")).first()
    if total is None:
        return Mix(1.0, 1.0, 0.0, 0.0)

    def tokens(x: float, norm: float) -> float:
        return budget if budget is not None else total * most ** (1 - x) * norm

    def solve(good_low: bool, good) -> float:
        """The end of the range of good exponents, which reaches to 0 if ``good_low``, else to 1."""
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            fits = [good(x, *s) for x, s in zip(grid, _sums(shares, grid), strict=True)]
            if good_low:
                at = max((i for i, f in enumerate(fits) if f), default=0)
                low, high = grid[at], grid[min(at + 1, SECTIONS)]
            else:
                at = min((i for i, f in enumerate(fits) if f), default=SECTIONS)
                low, high = grid[max(at - 1, 0)], grid[at]
        return low if good_low else high

    exponent = 1.0
    if target_entropy is not None:
        exponent = solve(True, lambda x, z, h: h >= target_entropy)
    if max_repeats is not None:
        limit = solve(False, lambda x, z, h: tokens(x, z) / total * least ** (x - 1) / z <= max_repeats * (1 + 1e-12))
        exponent = limit if target_entropy is None else max(exponent, limit)
    norm, entropy = _sums(shares, [exponent])[0]
    return Mix(exponent, norm, entropy, tokens(exponent, norm))


def whole_quota(quota: Column, total: Column, in_full: bool) -> Column:
    """The quota in whole tokens, one at least if there is any; with ``in_full`` at least the source's ``total``."""
    whole = F.greatest(F.round(quota), F.ceil(F.least(quota, F.lit(1.0)))).cast("long")
    return F.greatest(whole, total) if in_full else whole


def passes_due(quota: Column, before: Column, total: Column) -> Column:
    """In how many passes over a source a row starts below the quota; ``before`` is less than ``total``, all are whole."""
    ahead = quota - before + total - 1
    return ((ahead - ahead % total) / total).cast("int")


def mix_sources(
    docs: DataFrame, source: str = "source", text: str = "text", target_entropy: float | None = None,
    max_repeats: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 11,
    relative: bool = False,
) -> DataFrame:
    """The rows of ``docs``, each as often as its source's weight asks for, with ``mix_epoch``, ``mix_block`` and ``mix_turn``.

    Reading the rows by (mix_block, mix_turn) gives the mix: every block has the
    target weights as nearly as whole documents allow, and each is an own
    permutation. Tokens are words set apart by white space, at least one per row,
    so empty and null texts take part. A null source is a source of its own.
    With ``relative``, ``target_entropy`` is a part of the largest possible entropy.
    Equal rows are kept apart. An empty table gives no rows.
    """
    names = docs.columns
    rows = docs.select(
        F.struct(*[F.col(c) for c in names]).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("source"),
        F.greatest(F.lit(1), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+"))).cast("long").alias("tokens"),
        F.xxhash64(F.lit(seed), *[F.col(c) for c in names]).alias("key"),
    )
    shares = source_tokens(rows, "source", "tokens")
    count, all_rows = shares.agg(F.count("*"), F.sum("rows")).first()
    if target_entropy is not None and relative:
        target_entropy *= math.log(max(count, 1))
    mix = choose_exponent(shares, target_entropy, max_repeats, budget)
    blocks = max(1, math.ceil(mix.budget / block_tokens))
    share = F.pow("share", F.lit(mix.exponent)) / F.lit(mix.norm) * F.lit(mix.budget)
    facts = shares.select("source", F.col("tokens").alias("total"), whole_quota(share, F.col("tokens"), budget is None).alias("quota"))
    ranked = running_sum(rows, "source", F.col("key"), F.col("tokens"), slices_for(all_rows or 0), facts)
    # A row is due in a pass if the tokens before it, over all passes, stay below its source's quota.
    passes = passes_due(F.col("quota"), F.col("before"), F.col("total"))
    due = ranked.filter(passes > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), passes - 1)))
    at = (F.col("mix_epoch") * F.col("total") + F.col("before")) / F.col("quota")
    return due.select(
        *[F.col("row")[c].alias(c) for c in names], "mix_epoch",
        F.least(F.lit(blocks - 1), F.floor(at * blocks)).cast("long").alias("mix_block"),
        F.xxhash64(F.lit(seed + 1), "key", "mix_epoch").alias("mix_turn"),
    )


def mixed_order(mixed: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, epoch, block, position): the place of every row of a mix in its block."""
    narrow = mixed.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col("mix_epoch").alias("epoch"),
        F.col("mix_block").alias("block"), "mix_turn",
    )
    order = Window.partitionBy("block").orderBy("mix_turn", "doc_id", "epoch")
    return narrow.withColumn("position", F.row_number().over(order)).drop("mix_turn")
