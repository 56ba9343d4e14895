"""Packing documents into sequences by a plan over their lengths (operator 6).

The plan needs only how many pieces there are of each length, at most one
count per possible length. Best fit, longest first, is run on these counts:
all sequences with the same room left are one group, and a length fills whole
groups at a time. Pieces then take the planned places by their rank among the
pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.ranks import running_sum, slices_for
from tidewire.llm.tasks import map_rows
from tidewire.llm.tokens import encoded
from tidewire.session import cut_lineage

CAPACITY = 2048
PLAN = "length int, low long, high long, first long, per int, at int"


def token_pieces(docs: DataFrame, doc_id: str, text: str, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and its end id, cut at ``capacity``."""
    end = end_id.to_bytes(4, "little")
    step = 4 * capacity

    def cut(batches):
        for names, found in encoded(tokenizer, batches):
            out = [[], [], [], [], []]
            for name, ids in zip(names, found, strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(out, (name, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield out

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_rows(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces, as rows (length, low, high, first, per, at).

    The pieces of this length with ranks from low up to high go, ``per`` to a
    sequence, to the sequences from ``first`` on, at offset ``at``. Filling a
    group leaves less than half of its room, so a group is used at most
    log2(capacity) times, and each length opens or splits at most four:
    the plan is bounded by the capacity, however many documents there are.
    """
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    plan, opened = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, count))

    for length in sorted(counts, reverse=True):
        left, done = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            else:
                room, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            per = room // length
            whole = min(count, left // per)
            for per, n in ((per, whole), (left - whole * per if whole < count else 0, 1)):
                if per and n:
                    plan.append((length, done, done + per * n, first, per, capacity - room))
                    put(room - per * length, first, n)
                    first, count, done, left = first + n, count - n, done + per * n, left - per * n
            put(room, first, count)
    return plan


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json",
    end_id: int = 0, capacity: int = CAPACITY,
) -> DataFrame:
    """Every document's pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are cut only where a document is longer than ``capacity``. A null
    or empty text is its end id alone. Repeated rows are packed as often as
    they occur; an empty table gives no rows.
    """
    pieces = cut_lineage(token_pieces(docs, doc_id, text, tokenizer, end_id, capacity))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = docs.sparkSession.createDataFrame(plan_best_fit(counts, capacity), PLAN)
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    ranked = running_sum(pieces, "length", order, F.lit(1), slices_for(sum(counts.values())))
    placed = ranked.join(F.broadcast(plan), "length").filter("before >= low AND before < high")
    turn = F.col("before") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(turn / F.col("per"))).alias("sequence_id"),
        (F.col("at") + F.pmod(turn, F.col("per")) * F.col("length")).alias("offset"),
    )
