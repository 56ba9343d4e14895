"""Collocated phrases from sorted count streams (operator 11).

Every place of a text opens a window of three words, cut off at the end of its
piece. Tasks sort the windows of their texts, count them, and cut these sorted runs at common
boundaries. The runs of a range are merged in prefix order: neighbours with the
same one, two or three words first add up to the counts of phrases of that
length, so no table of counts is ever held. What occurs often enough is kept in
prefix order and in suffix order (last word first). Merge joins along the first give the count of
what a phrase begins with and its most frequent longer form to the right; along the second
the count of what it ends with, and the longer form to the left.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.tasks import map_rows
from tidewire.session import cut_lineage

LEAST = 10
COVERED = (50, 100)  # a phrase goes if a longer one has at least so large a part of its occurrences
TOP = 2000
RUN_PLACES = 1 << 22  # places counted in one sorted run
BITS = 21
RUN_WORDS = (1 << BITS) - 1  # different words in one, so that three numbers fit in 63 bits
READ_BYTES = 1 << 20
PART_BYTES = 8 << 20  # bytes of text per range of the sorted stream
SAMPLE_TEXTS = 4000  # texts, about, that the boundaries of the ranges come from; they decide how even these are, not what is counted
SAMPLE_BYTES = 2000  # of each
BREAK = b"\xff"  # occurs in no text
RUN = "part int, lang string, words binary, places binary, counts binary"
COUNT = "lang string, w1 string, w2 string, w3 string, f long, open boolean"
_TABLE = bytes(range(65, 91)) + b"\t" + b".,;:!?\n\x0b\x0c\r"
CLEAN = bytes.maketrans(_TABLE, bytes(range(97, 123)) + b" " + BREAK * 10)


def pieces(texts: list[bytes]) -> bytes:
    """Texts in one, lower case, with a mark at the end of each piece."""
    return BREAK.join([*texts, b""]).translate(CLEAN).replace(BREAK, b" " + BREAK + b" ")


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def open_up(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Run:
    """Windows of some texts, by language; words are numbered as they come, 0 is the end of a piece."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[BREAK] = 0
        self.held: dict[str, list[np.ndarray]] = defaultdict(list)
        self.places = 0

    def add(self, lang: str, data: bytes) -> None:
        words = data.split()
        self.held[lang].append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.places += len(words)

    def full(self) -> bool:
        return self.places >= RUN_PLACES or len(self.number) > RUN_WORDS - READ_BYTES // 2

    def windows(self, going_on: str | None = None):
        """(lang, words in order, window keys in order, counts) of each language; a key has the places of three words.

        Word 0 is the empty one; the window of it alone counts all words. The last two places of the language that is
        ``going_on`` have no full window yet and are left out.
        """
        words = list(self.number)
        order = sorted(range(1, len(words)), key=words.__getitem__)
        rank = np.zeros(len(words), np.int64)
        rank[order] = np.arange(1, len(words))
        named = [b"", *(words[i] for i in order)]
        for lang in sorted(self.held):
            x = rank[np.concatenate(self.held[lang] if lang == going_on else [*self.held[lang], np.zeros(2, np.int32)])]
            a, b, c = x[:-2], x[1:-1], x[2:]
            c = np.where(b > 0, c, 0)
            key = ((a << 2 * BITS) | (b << BITS) | c)[a > 0]
            if len(key):
                total = len(key)
                key.sort()
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                counts = np.concatenate([[total], np.diff(np.append(start, total))])
                yield lang, named, np.concatenate([[0], key[start]]), counts

    def following(self, lang: str) -> Run:
        """An empty run that goes on with the last two words of a language."""
        words, last = list(self.number), np.concatenate(self.held[lang])[-2:]
        rest = Run()
        rest.add(lang, b" ".join(words[i] for i in last))
        return rest


def split_key(key):
    """The places of the three words."""
    return [key >> 2 * BITS, key >> BITS & RUN_WORDS, key & RUN_WORDS]


def first_at_or_after(named: list[bytes], words: tuple[bytes, ...]) -> int:
    """The least key, in the numbers of ``named``, that does not come before a window of ``words``."""
    key = 0
    for i, word in enumerate(words):
        at = bisect_left(named, word)
        key |= at << BITS * (2 - i)
        if at == len(named) or named[at] != word:
            break
    return key


def boundaries(docs: DataFrame, parts: int, share: float) -> list[tuple]:
    """Up to ``parts`` - 1 windows, (lang, three words), that cut a sample of a ``share`` of the texts into equal ranges."""
    some = docs.sample(min(1.0, share), seed=5).limit(2 * SAMPLE_TEXTS)
    sample = some.select("lang", F.substring("text", 1, SAMPLE_BYTES).alias("text")).collect()
    own = Run()
    for r in sample:
        own.add(r.lang, pieces([bytes(r.text)]))
    found = [(lang, named, key, np.cumsum(counts[1:])) for lang, named, key, counts in own.windows()]
    total, before, out = sum(int(f[3][-1]) for f in found), 0, set()
    cuts = [total * i // parts for i in range(1, parts)]
    for lang, named, key, ends in found:
        out.add((lang, b"", b"", b""))
        for cut in cuts:
            if before <= cut < before + ends[-1]:
                k = key[1 + int(np.searchsorted(ends, cut - before, side="right"))]
                out.add((lang, *(named[int(w)] for w in split_key(k))))
        before += int(ends[-1])
    return sorted(out, key=lambda w: (w[0].encode(), *w[1:]))


def count_runs(docs: DataFrame, bounds: list[tuple]) -> DataFrame:
    """(part, lang, words, places, counts): sorted runs of counted windows, cut at ``bounds``, from (lang, text as bytes).

    Each row has the windows of one run, range and language: their words in order, and for each window, in order,
    the places of its three words there, and how often it occurs.
    """
    langs = [b[0].encode() for b in bounds]
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(bounds)

    def cut(own: Run, going_on=None):
        for lang, named, key, counts in own.windows(going_on):
            low, high = bisect_left(langs, lang.encode()), bisect_left(langs, lang.encode() + b"\x00")
            at = np.searchsorted(key, [first_at_or_after(named, b[1:]) for b in sent.value[low:high]])
            edges = [0, *at.tolist(), len(key)]
            for i, (start, stop) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if start < stop:
                    words = split_key(key[start:stop])
                    used = np.zeros(len(named), bool)
                    for w in words:
                        used[w] = True
                    used = np.flatnonzero(used)
                    place = np.zeros(len(named), np.uint32)
                    place[used] = np.arange(len(used))
                    yield [[low + i], [lang], [squeeze(b" ".join([named[w] for w in used.tolist()]))],
                           [squeeze(b"".join(place[w].tobytes() for w in words))], [squeeze(counts[start:stop].astype("<u4").tobytes())]]

    def run(batches):
        own = Run()
        for langs, texts in batches:
            grouped = defaultdict(list)
            for name, data in zip(langs, texts, strict=True):
                grouped[name].append(data)
            for name, own_texts in grouped.items():
                data, at = pieces(own_texts), 0
                while at < len(data):
                    end = data.find(b" ", at + READ_BYTES)
                    end = len(data) if end < 0 else end
                    own.add(name, data[at:end])
                    at = end
                    if own.full():
                        yield from cut(own, name)
                        own = own.following(name)
        yield from cut(own)

    return map_rows(docs, run, RUN)


def merged(runs: list[tuple[bytes, bytes, bytes]]) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """(words in order, places of the three words of each window, counts) of several runs; windows in order, each once."""
    words = [open_up(r[0]).split(b" ") for r in runs]
    named = sorted(set().union(*words))
    place = {w: i for i, w in enumerate(named)}
    columns = [[], [], []]
    for own, (_, places, _) in zip(words, runs, strict=True):
        number = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
        for column, values in zip(columns, np.frombuffer(open_up(places), np.uint32).reshape(3, -1), strict=True):
            column.append(number[values])
    a, b, c = map(np.concatenate, columns)
    counts = np.concatenate([np.frombuffer(open_up(r[2]), "<u4") for r in runs]).astype(np.int64)
    if len(named) <= RUN_WORDS:
        order = np.argsort((a << 2 * BITS) | (b << BITS) | c, kind="stable")
    else:
        order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
    return named, [a[new], b[new], c[new]], np.add.reduceat(counts[order], new)


def merge_runs(runs: DataFrame, parts: int, least: int) -> DataFrame:
    """(lang, w1, w2, w3, f): how often each phrase of one to three words occurs, if at least ``least`` times.

    A word that begins a great many windows is dealt to many ranges. A range does not know all of the first and the last phrase
    of each length in it; it hands these on as they are, and they are added up.
    """

    def phrases(lang: str, own: list):
        named, words, counts = merged(own)
        total = np.concatenate([[0], np.cumsum(counts)])
        names = pa.array(named, pa.string())
        new = np.zeros(len(counts), bool)
        new[0] = True
        for length in (1, 2, 3):
            word = words[length - 1]
            new[1:] |= word[1:] != word[:-1]
            at = np.flatnonzero(new)
            f = np.diff(np.append(total[at], total[-1]))
            edge = np.zeros(len(at), bool)
            edge[[0, -1]] = True
            keep = (f >= least) | edge
            if length > 1:  # a window that ends before is no phrase of this length
                keep &= word[at] > 0 if named[0] == b"" else True
            at, n = at[keep], int(keep.sum())
            columns = [names.take(pa.array(w[at])) if i < length else pa.array([""] * n, pa.string()) for i, w in enumerate(words)]
            yield [pa.array([lang] * n, pa.string()), *columns, pa.array(f[keep]), pa.array(edge[keep])]

    def run(batches):
        at, held = None, []
        for part, lang, *own in (r for b in batches for r in zip(*b, strict=True)):
            if (part, lang) != at:
                if held:
                    yield from phrases(at[1], held)
                at, held = (part, lang), []
            held.append(own)
        if held:
            yield from phrases(at[1], held)

    dealt = runs.repartitionById(parts, "part").sortWithinPartitions("part", "lang")
    counted = cut_lineage(map_rows(dealt, run, COUNT))
    split = counted.filter("open").groupBy("lang", "w1", "w2", "w3").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return counted.filter("NOT open").drop("open").unionByName(split)


def counts_of(docs: DataFrame, lang: str, text: str, least: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, w1, w2, w3, f) of all phrases of up to three words that occur at least ``least`` times; w1 is empty for all words."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    size, count = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    bounds = boundaries(rows, max(1, math.ceil((size or 0) / part_bytes)), SAMPLE_TEXTS / max(1, count))
    # Ranges are numbered from 0; what comes before a boundary has the number of that boundary.
    return merge_runs(count_runs(rows, bounds), len(bounds) + 1, least)


def in_context(grams: DataFrame, words: list[str], begin: str, longer: str) -> tuple[DataFrame, DataFrame]:
    """Phrases of two and of three words, read in the order of ``words``, with the counts of what they begin with.

    Merge joins along this order give two words the count ``begin``1 of the
    first, and ``longer``, the largest count of three words that go on from them;
    three words get ``begin``1 and ``begin``2, the counts of their first word and first two.
    """
    a, b, c = words
    one = grams.filter("size = 1").select("lang", F.col("w1").alias(a), F.col("f").alias(f"{begin}1")).hint("merge")
    two, three = grams.filter("size = 2"), grams.filter("size = 3")
    pair = two.select("lang", F.col("w1" if a < b else "w2").alias(a), F.col("w2" if a < b else "w1").alias(b), F.col("f").alias(f"{begin}2"))
    most = three.groupBy("lang", a, b).agg(F.max("f").alias(longer)).hint("merge")
    pair = pair.join(one, ["lang", a])
    pairs = pair.join(most, ["lang", a, b], "left")
    triples = three.join(pair.hint("merge"), ["lang", a, b])
    return pairs, triples.select("lang", *words, f"{begin}1", f"{begin}2")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or three words of each language.

    Letters A-Z count as a-z; pieces end at marks and line ends, words at
    blanks and tabs. ``a`` is how often the phrase occurs, ``n`` how many words the language has, ``l`` and
    ``r`` how often the two parts of its lowest-scoring cut occur, and ``score`` is 1000000 a a / (l r), rounded down. Phrases
    of which a longer one has half of the occurrences are left out. Ranks go by score,
    then ``a``, then phrase in byte order. A null language is ``und``, a null or blank text has no words;
    repeated rows count as often as they occur. An empty table gives no rows.
    """
    size = F.when(F.col("w2") == "", 1).when(F.col("w3") == "", 2).otherwise(3)
    grams = cut_lineage(counts_of(docs, lang, text, least).withColumn("size", size))
    totals = grams.filter("size = 1 AND w1 = ''").select("lang", F.col("f").alias("n"))
    grams = grams.filter("w1 <> ''")
    before2, before3 = in_context(grams, ["w1", "w2", "w3"], "l", "to_right")
    after2, after3 = in_context(grams, ["w3", "w2", "w1"], "r", "to_left")
    # Two words read backwards are called w3 and w2.
    after2 = after2.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("r1").alias("r"), "to_left")
    least_part, all_of = COVERED
    pairs = before2.join(after2.hint("merge"), ["lang", "w1", "w2"])
    free = F.coalesce(F.greatest("to_right", "to_left"), F.lit(0)) * all_of < F.col("l2") * least_part
    pairs = pairs.filter(free).select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("l2").alias("a"), F.col("l1").alias("l"), "r")
    pairs = pairs.withColumn("score", _score("a", "l", "r"))
    triples = grams.filter("size = 3").select("lang", "w1", "w2", "w3", F.col("f").alias("a"))
    triples = triples.join(before3.hint("merge"), ["lang", "w1", "w2", "w3"]).join(after3.hint("merge"), ["lang", "w1", "w2", "w3"])
    cuts = [F.struct(_score("a", l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, (l, r) in enumerate([("l1", "r2"), ("l2", "r1")])]
    triples = triples.withColumn("cut", F.least(*cuts))
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = pairs.unionByName(triples).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _score(a: str, l: str, r: str):
    """Exact to 38 digits."""
    whole = [f"CAST({x} AS DECIMAL(19, 0))" for x in (a, l, r)]
    return F.expr("(CAST(1000000 AS DECIMAL(7, 0)) * ({0} * {0})) div ({1} * {2})".format(*whole))
