"""Greedy keep-first against brute force, keep-first by URL, quotas and merges."""

import random
from itertools import pairwise

from pyspark.sql import functions as F

from tidewire.functions.minhash import PRIME, band_keys, minhash_signature
from tidewire.operators import dedup, hotkeys, merge, neardup, quota
from tidewire.operators.components import components
from tidewire.plans.clean import clean_articles


def brute_force(bands: dict[int, list[str]]) -> set[int]:
    kept, taken = set(), set()
    for seq in sorted(bands):
        if not taken & set(bands[seq]):
            kept.add(seq)
            taken |= set(bands[seq])
    return kept


def as_frame(spark, bands):
    rows = [(seq, [bytes(f"{i}:{b}", "ascii") for i, b in enumerate(keys)]) for seq, keys in bands.items()]
    return spark.createDataFrame(rows, "seq long, bands array<binary>")


def kept_set(spark, bands, per_text):
    named = {s: [f"{i}:{b}" for i, b in enumerate(k)] for s, k in bands.items()}
    got = neardup.greedy_keep_first(as_frame(spark, bands), per_text)
    return {r[0] for r in got.collect()}, brute_force(named)


def test_chain_keeps_both_ends(spark):
    # 1 meets 2, 2 meets 3, 1 does not meet 3: only 2 goes.
    got, expected = kept_set(spark, {1: ["a", "x"], 2: ["a", "y"], 3: ["b", "y"]}, 2)
    assert got == expected == {1, 3}


def test_random_groups_match_brute_force(spark):
    rng = random.Random(7)
    for size in (2, 4):
        bands = {i: [rng.randrange(size * 6) for _ in range(3)] for i in range(60)}
        got, expected = kept_set(spark, bands, 3)
        assert got == expected


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    # Text i shares a key with the one before it and one with the one after it, 2,000 texts long.
    chain = {i: [i // 2, (i + 1) // 2] for i in range(2000)}
    rounds, firsts = [], neardup.band_firsts
    monkeypatch.setattr(neardup, "band_firsts", lambda rows: rounds.append(1) or firsts(rows))
    got, expected = kept_set(spark, chain, 2)
    assert got == expected and len(got) == 1000
    assert len(rounds) <= neardup.FREE_ROUNDS + 1


def test_parts_over_the_bound_go_on_by_rounds(spark, monkeypatch):
    rng = random.Random(11)
    bands = {i: [i // 2, (i + 1) // 2] for i in range(24)} | {100 + i: [100 + i // 2, 100 + (i + 1) // 2] for i in range(12)}
    bands |= {200 + i: [200 + rng.randrange(90), 300 + rng.randrange(90)] for i in range(60)}
    monkeypatch.setattr(neardup, "FREE_ROUNDS", 1)
    for bound in (0, 12, 50_000):
        monkeypatch.setattr(neardup, "PART_TEXTS", bound)
        got, expected = kept_set(spark, bands, 2)
        assert got == expected


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_crowded_band_with_hot_path(spark, monkeypatch):
    # A third of all texts share one key without being equal; force the broadcast path.
    monkeypatch.setattr(hotkeys, "HOT_ROWS", 5)
    rng = random.Random(3)
    bands = {i: ["hot" if i % 3 == 0 else rng.randrange(500), rng.randrange(400)] for i in range(300)}
    got, expected = kept_set(spark, bands, 2)
    assert got == expected
    frame = as_frame(spark, bands)
    kept = neardup.greedy_keep_first(frame, 2)
    partners = {r["seq"]: r["kept_seq"] for r in neardup.kept_partners(frame, kept).collect()}
    assert set(partners) == set(bands) - expected
    assert all(p in expected and p < s for s, p in partners.items())


def test_stars_connect_all_colliding_texts(spark):
    rows = neardup.explode_bands(as_frame(spark, {5: ["a", "p"], 6: ["a", "q"], 7: ["b", "q"], 8: ["c", "r"]}))
    assert {tuple(r) for r in neardup.collision_stars(rows).collect()} == {(6, 5), (7, 6)}


def test_signature_of_nothing_and_of_copies(spark):
    df = spark.createDataFrame([(0, ""), (1, "  "), (2, None), (3, "a b c"), (4, "c  b a a")], "i int, t string")
    sig = {r[0]: r[1] for r in df.select("i", minhash_signature(F.col("t"))).collect()}
    assert sig[0] == sig[1] == sig[2] == [PRIME] * 128 and sig[3] == sig[4] != sig[0]
    assert df.select(F.size(band_keys(minhash_signature(F.col("t"))))).first()[0] == 9


def test_signature_estimates_jaccard(spark):
    a, b = [f"w{i}" for i in range(1000)], [f"w{i}" for i in range(200, 1200)]
    df = spark.createDataFrame([(" ".join(a),), (" ".join(b),)], "t string")
    x, y = [r[0] for r in df.select(minhash_signature(F.col("t"))).collect()]
    assert abs(sum(i == j for i, j in zip(x, y, strict=True)) / 128 - 800 / 1200) < 0.15


def test_keep_first_and_its_plan(spark):
    df = spark.createDataFrame([(3, "u"), (1, "u"), (2, "v"), (4, None), (5, None)], "seq int, url string")
    first = dedup.keep_first(df, "url", "seq")
    assert {tuple(r) for r in first.collect()} == {(1, "u"), (2, "v"), (4, None)}
    plan = first._jdf.queryExecution().executedPlan().toString()
    # Each task drops all but its first row per key before anything is shuffled.
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_stored_and_missing_urls(spark):
    stored = spark.createDataFrame([("a",), (None,)], "url string")
    feed_a = spark.createDataFrame([(1, "b", "A"), (2, None, "A"), (3, None, "A2"), (4, "a", "A")], "seq int, url string, source string")
    feed_b = spark.createDataFrame([(1, "b", "B"), (2, "c", "B"), (3, None, "B")], "seq int, url string, source string")
    new = merge.new_from_feeds(stored, feed_a, feed_b)
    assert {(r["url"], r["source"]) for r in new.collect()} == {("b", "A"), (None, "A"), ("c", "B")}
    assert merge.merge_feeds(stored, feed_a, feed_b).count() == 5


def test_quota_counts_whole_files(spark):
    rows = spark.createDataFrame([(f, f"{f}-{i}") for f in range(3) for i in range(3)], "file_no int, url string")
    files = spark.createDataFrame([(i,) for i in range(4)], "file_no int")
    accepted, tried = quota.quota_by_file(rows, files, 5)
    assert accepted.count() == 6 and {r["file_no"] for r in tried.collect()} == {0, 1}
    assert quota.quota_by_file(rows, files, 100)[1].count() == 4
    assert quota.quota_by_file(rows, files, 0)[0].count() == 0


def test_skipped_file_does_not_hide_a_url_from_the_next_window(spark):
    from tidewire.plans.collect import collect_windows

    rows = [("01", n, f"http://h/{u}", "vote") for n, u in enumerate("abc")]
    rows += [("02", 0, "http://h/d", "vote"), ("11", 0, "http://h/d", "vote"), ("11", 1, "http://h/a", "vote")]
    lines = spark.createDataFrame(
        [(s, n, "20240101", "src", u, th, "1,2") for s, n, u, th in rows],
        "slot string, line_no int, date string, source string, url string, themes string, tone_csv string",
    )
    slots = spark.createDataFrame([("w0", 0, "01"), ("w0", 1, "02"), ("w1", 0, "11")], "name string, file_no int, slot string")
    stored = spark.createDataFrame([], "url string")
    got = {(r["window"], r["url"][-1]) for r in collect_windows(lines, slots, stored, target_total=4).collect()}
    assert got == {("w0", "a"), ("w0", "b"), ("w0", "c"), ("w1", "d")}


def test_cleaning_identity_and_order(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, "http://a/1?x", "2024-01-02", long), (2, "http://a/1#y", "2024-01-03", "other text"), (3, "", "2024-01-02", long),
        (4, None, None, long), (5, "http://a/2", "bad", long), (6, "http://a/3", "", ""), (7, "http://a/4", None, None),
        (8, "http://a/5", "20240805T120000Z", "short one"), (9, "http://a/6", None, "   "), (10, "http://a/7", None, "\t"),
    ]
    raw = spark.createDataFrame(rows, "seq long, url string, published_at string, body string")
    clean, report = clean_articles(raw)
    assert [r["seq"] for r in clean.orderBy("seq").collect()] == [1, 8, 9]
    r = report.first()
    assert r.asDict() == {"initial": 10, "url_duplicates": 3, "body_duplicates": 2, "invalid_dates": 5, "short_bodies": 5, "final": 3}
    empty_bodies = 2
    assert r["initial"] == r["url_duplicates"] + empty_bodies + r["body_duplicates"] + r["final"]


def test_no_pairs_and_no_cross_join_in_plans(spark):
    rows = neardup.explode_bands(as_frame(spark, {i: [str(i % 5)] for i in range(20)}))
    for df in (neardup.collision_stars(rows), neardup.band_firsts(rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pair_jaccard(spark):
    texts = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["a", "b"]), (4, [])], "seq long, words array<string>")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (4, 1)], "l long, r long")
    got = {r["l"]: r["jaccard"] for r in neardup.pair_jaccard(pairs, texts, "l", "r").collect()}
    assert got == {2: 1 / 3, 3: 1.0, 4: 0.0}


def test_pairwise_order_of_kept(spark):
    bands = {i: [i // 2, (i + 1) // 2] for i in range(20)}
    got, expected = kept_set(spark, bands, 2)
    assert got == expected and all(a < b for a, b in pairwise(sorted(got)))
