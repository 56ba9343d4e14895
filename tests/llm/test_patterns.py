"""Collocations, near-duplicate vectors and periodic runs against plain versions, and on edge rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import connect, differences

from tidewire.llm import collocations, periodic, pq
from tidewire.llm import queries as registered
from tidewire.llm.queries import planted_period

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, head string, w1 string, n long, f long, runs string, start string, node string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", "h", "w", 1, 2, "r", "x", "y") for i, t, g in rows], DOCS).repartition(3)


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_matches_sql(spark, name):
    assert differences(registered.QUERIES[name](spark, SF), connect(SF), registered.ORACLES[name]) is None


# --- collocations -------------------------------------------------------------------------------------


def plain_collocations(rows, least, top):
    pieces = []
    for _, text, lang in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        pieces += [("und" if lang is None else lang, re.findall(r"[^ \t]+", p)) for p in re.split(r"[.,;:!?\n-\r]", lowered)]
    f = Counter((g, tuple(w[i : i + k])) for g, w in pieces for k in (1, 2, 3) for i in range(len(w) - k + 1))
    n = Counter()
    for g, w in pieces:
        n[g] += len(w)
    out = []
    for (g, w), a in f.items():
        if len(w) == 1 or a < least:
            continue
        if len(w) == 2 and any(h == g and len(x) == 3 and b >= least and w in (x[:2], x[1:]) and 100 * b >= 50 * a for (h, x), b in f.items()):
            continue
        score, _, l, r = min((1000000 * a * a // (f[g, w[:k]] * f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
        out.append((g, " ".join(w), a, l, r, n[g], score))
    ranked = []
    for g in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == g), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(g, i + 1, *o[1:]) for i, o in enumerate(own[:top])]
    return sorted(ranked)


PHRASES = [
    (1, "New York, new york! NEW YORK city", "en"), (1, "New York, new york! NEW YORK city", "en"), (2, None, "en"), (3, "", None), (4, " \t ..,\n", "fr"),
    (5, "a a a a a a", None), (6, "a\tb a b\x01 a b\x02. É É b", "und"), (None, "new york city of new york city", "en"), (7, "x y\rz x y\x0bz\x0cx y", "a\tb"),
    (8, "日本 語 日本 語 日本", ""), (9, "I am I AM i am", "a"), (10, "word " * 3000, "long"),
]


@pytest.mark.parametrize("least, top", [(1, 50), (2, 3), (3, 2000)])
def test_collocations_equal_plain_counts(spark, least, top):
    found = collocations.collocations(docs_of(spark, PHRASES), least=least, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain_collocations(PHRASES, least, top)


@pytest.mark.parametrize("part_bytes", [10**9, 600, 40])
def test_stream_split_anywhere_gives_the_same_counts(spark, part_bytes):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("the of a b c d".split()) for _ in range(60)), rng.choice(["en", "e", "en\x00"])) for i in range(40)]
    found = sorted(map(tuple, collocations.counts_of(docs_of(spark, rows), "lang", "text", 4, part_bytes).collect()))
    counts = Counter()
    for _, t, g in rows:
        w = t.split()
        counts.update((g, *[*w[i : i + k], "", ""][:3]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert [r for r in found if r[1]] == sorted((*w, n) for w, n in counts.items() if n >= 4) and len(found) > 30


def test_too_many_words_for_one_key(monkeypatch):
    run = collocations.Run()
    run.add("en", b"b a c a b a c b b a b a")
    rows = [(b" ".join(named), b"".join(w.astype(np.uint32).tobytes() for w in collocations.split_key(key)), n.astype("<u4").tobytes()) for _, named, key, n in run.windows()]
    rows = [tuple(map(collocations.squeeze, r)) for r in rows] * 2
    named, words, counts = collocations.merged(rows)
    monkeypatch.setattr(collocations, "RUN_WORDS", 1)
    again = collocations.merged(rows)
    assert named == again[0] and np.array_equal(words, again[1]) and np.array_equal(counts, again[2]) and counts[0] == 24


def test_runs_cut_inside_a_piece_lose_no_window(monkeypatch):
    words = [random.Random(5 + i).choice(["ab", "c", "the"]) for i in range(900)]
    monkeypatch.setattr(collocations, "RUN_PLACES", 50)
    own, counts, runs = collocations.Run(), Counter(), 0

    def count(windows):
        for _, named, key, n in windows:
            for *w, k in zip(*collocations.split_key(key), n, strict=True):
                counts[tuple(named[i].decode() for i in w)] += int(k)

    for i in range(0, 900, 9):
        own.add("en", " ".join(words[i : i + 9]).encode())
        if own.full():
            count(own.windows("en"))
            own, runs = own.following("en"), runs + 1
    count(own.windows())
    wanted = Counter((words[i], *[*words[i + 1 : i + 3], "", ""][:2]) for i in range(900))
    wanted["", "", ""] = 900
    assert counts == wanted and runs > 10


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, PHRASES).limit(0)).count() == 0


# --- near-duplicate vectors ---------------------------------------------------------------------------


def plain_links(rows, cosine=0.95):
    good = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, top = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in good:
        for b in good:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], float) for i in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    i, j = root(a), root(b)
                    top[max(i, j)] = min(i, j)
    least = {}
    for i in good:
        least[root(i)] = min(rows[i][0], least.get(root(i), rows[i][0]))
    return sorted(((d, links[i], least[root(i)] if i in good else d, not (i in good and least[root(i)] != d)) for i, (d, _) in enumerate(rows)), key=str)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n", "x") for i, v in rows], "vec_id long, embedding array<double>, node int, v string, list string").repartition(3)


def planted(seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(150, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(250):  # near the limit, so some link and some do not
        v = base[rng.integers(30)] + rng.normal(size=12) * rng.choice([0.05, 0.3, 0.4])
        rows.append((1000 - i, (v * rng.choice([1, 7.5])).tolist()))
    return rows + [rows[3]] * 20 + [(5, rows[160][1])]


@pytest.mark.parametrize("lists", [1, 9, 40])
def test_links_equal_all_pairs(spark, monkeypatch, lists):
    monkeypatch.setattr(pq, "PIECE_ROWS", 16)
    monkeypatch.setattr(pq, "ASKED_ROWS", 30)
    monkeypatch.setattr(pq, "TURN_ROWS", 7)
    rows = planted(lists)
    found = pq.near_duplicates(vectors_of(spark, rows), lists=lists)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    expected = plain_links(rows)
    assert sorted(map(tuple, found.collect()), key=str) == expected and sum(r[1] > 0 for r in expected) > 100


def test_recall_near_the_limit(spark):
    rng = np.random.default_rng(4)
    base = pq.unit(rng.normal(size=(3000, 64)))
    side = rng.normal(size=base.shape)
    side = pq.unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    angle = np.arccos(rng.uniform(0.95, 0.97, (3000, 1)))
    rows = list(enumerate(np.concatenate([base, np.cos(angle) * base + np.sin(angle) * side]).tolist()))
    found = {r.vec_id: r.component_id for r in pq.near_duplicates(vectors_of(spark, rows), lists=200).collect()}
    caught = sum(found[i + 3000] == i for i in range(3000))
    assert caught >= 0.995 * 3000


def test_lists_left_out_hold_no_linked_vector_and_most_codes_are_left_out():
    x = pq.unit(np.random.default_rng(1).normal(size=(6000, 64)))
    x[3000:] = pq.unit(x[:3000] + 0.03 * np.random.default_rng(2).normal(size=(3000, 64)))
    q = pq.Quantiser(x[::2], 400)
    own, codes, error = q.encode(x)
    far = np.sqrt(2 - 2 * 0.95)
    who, where = q.probes(x, own, far)
    asked = set(zip(who.tolist(), where.tolist(), strict=True))
    near = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    assert len(near) > 2500
    for a, b in near.tolist():
        a, b = (a, b) if own[a] <= own[b] else (b, a)
        assert own[a] == own[b] or (a, own[b]) in asked
    assert len(who) < 0.6 * len(x) * len(q.centres) / 2  # of the lists after the own one, half of all
    t = q.tables(x[:1], int(own[0]))
    held = np.flatnonzero(own == own[0])
    square = sum(t[i][0, codes[held, i]] for i in range(pq.SUBSPACES))
    said = q.centres[own[0]] + np.concatenate([w[codes[held, i]] for i, w in enumerate(q.words)], axis=1)
    assert np.allclose(square, ((x[0] - said) ** 2).sum(axis=1), atol=1e-4)
    assert np.all(np.abs(np.sqrt(((x[held] - said) ** 2).sum(axis=1)) - error[held]) < 1e-6)


ODD = [
    (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 0.0]), (None, None),
    (7, [1.0, 0.0]), (8, [2.0, 0.1]), (8, [2.0, 0.1]), (9, [-1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-300, 1e-301]), (12, [1e300, 1e299]), (13, [5.0]),
]


def test_odd_vectors(spark):
    assert sorted(map(tuple, pq.near_duplicates(vectors_of(spark, ODD)).collect()), key=str) == plain_links(ODD)
    assert pq.near_duplicates(vectors_of(spark, ODD).limit(0)).count() == 0


# --- periodic runs ------------------------------------------------------------------------------------


def plain_runs(words, periods=4, least=6):
    out = []
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if j > i and len(part) >= max(least, periods * q) and not any(part[g:] == part[:-g] for g in range(1, q)):
                out.append((i, len(part), q))
            i = max(j, i + 1) if j == i else j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        for _ in range(rng.randrange(1, 9)):
            some = [f"w{rng.randrange(rng.choice([2, 3, 40]))}" for _ in range(rng.randrange(1, 14))]
            words += some * rng.randrange(1, 7) + some[: rng.randrange(len(some) + 1)]
        yield words


def test_runs_equal_plain_search():
    for words in sequences(1, 400):
        names = {w: i for i, w in enumerate(sorted(set(words)))}
        x = np.array([names[w] for w in words] + [len(names)])
        found = sorted(periodic.runs_of(x, np.array([len(words)])), key=lambda r: (r[0], r[2]))
        assert [(s, e - s, q) for s, e, q in found] == plain_runs(words)


@pytest.mark.parametrize("size", [1, 2, 8, 256])
def test_occurrences_are_those_of_a_plain_comparison(size):
    rng = np.random.default_rng(size)
    blocks, windows = rng.integers(0, 2, (40, size)), rng.integers(0, 2, (40, 2 * size))
    for i in range(0, 40, 2):
        at = rng.integers(size)
        windows[i, at : at + size] = blocks[i] = blocks[i] * 1_000_000_007
    plain = np.array([[np.array_equal(b, w[j : j + size]) for j in range(size)] for b, w in zip(blocks, windows, strict=True)])
    assert np.array_equal(periodic.occurrences(blocks, windows), plain) and plain.any()


def test_long_repetitions_are_found_fast():
    for period in (1, 3, 1000, 20_000):
        x = np.append(np.tile(np.arange(period), 100_000 // period + 1)[:100_000], period)
        assert periodic.runs_of(x, np.array([100_000])) == [(0, 100_000, period)]


def digests(words):
    runs, keep = plain_runs(words), [True] * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = [False] * (length - period)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = b" ".join(w for w, k in zip(words, keep, strict=True) if k)
    milli = best[1] * 1000 // best[2] if runs else None
    return len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_registered_periodic_query(spark, tmp_path):
    rows = [(i, " ".join(w), "en") for i, w in enumerate(sequences(2, 150))]
    rows += [(1000, None, None), (1001, "", None), (1002, " \n\t", "en"), (1003, "é\x1cé é\x1cé é\x1cé é\x1cé é\x1cé é\x1cé", "en"), (None, "a a a a a a", "en"), rows[3], rows[3]]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted((tuple(r) for r in registered.op13_periodic(spark, str(tmp_path)).collect()), key=str)
    plain = [(i, *digests(planted_period(i, (t or "").encode().split()))) for i, t, _ in rows]
    assert found == sorted(plain, key=str) and sum(r[1] > 0 for r in plain) > 50


def test_periodic_runs_give_texts_and_spans(spark):
    rows = [(1, "x a b a b a b a b a b y", "en"), (2, "one two", "en")]
    one, two = sorted(periodic.periodic_runs(docs_of(spark, rows)).collect())
    assert (one.collapsed, [tuple(r) for r in one.runs], one.exponent_milli) == ("x a b y", [(1, 10, 2)], 5000)
    assert (two.collapsed, two.runs, two.start) == ("one two", [], None)
    assert periodic.periodic_runs(docs_of(spark, rows).limit(0)).count() == 0
