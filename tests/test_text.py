"""Edge rows of the URL, date, tone, text and score rules."""

import math
from urllib.parse import urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, fields, scores, stats, text, urls
from tidewire.operators import filters, lexicon, scoring


def one(spark, column_of, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column_of(F.col("v"))).collect()]


def expected_url(url):
    try:
        p = urlparse(url)
        return urlunparse((p.scheme, p.netloc, p.path, "", "", "")).rstrip("/")
    except ValueError:
        return url


def test_normalize_url(spark):
    cases = [
        "http://a.com/x?q=1#f", "https://a.com/", "HTTP://A.com/P//", "http://a.com/p;v=1?x", "http://a.com?q=1",
        " http://a.com/x", "http://[bad", "", "http://a.com/a;b/c;d", "http://[::1]/x/", "http://a.com/x\n?y", "a.com/x/",
        "http://a.com/#?", "mailto:x@y.org", "http://a.com/x#a/b;c?d", "//host/p//", "http://a.com/%20;", "?q",
    ]
    assert one(spark, urls.normalize_url, cases) == [expected_url(c) for c in cases]
    assert one(spark, urls.normalize_url, [None]) == [None]


def test_normalize_date(spark):
    cases = {
        "20240805T120000Z": "2024-08-05T12:00:00+00:00", "2024-08-05T12:00:00+02:00": "2024-08-05T10:00:00+00:00",
        "2024-08-05 12:00": "2024-08-05T12:00:00+00:00", "2024-08-05": "2024-08-05T00:00:00+00:00",
        "2024-08-05T12:00:00.250000Z": "2024-08-05T12:00:00.250000+00:00", "20240805120000": "2024-08-05T12:00:00+00:00",
        "Mon, 05 Aug 2024 12:00:00 +0000": "2024-08-05T12:00:00+00:00", "garbage": None, "": None, None: None,
        "10:30": None, "2024-13-45": None,
    }
    assert one(spark, dates.normalize_date, list(cases)) == list(cases.values())


def test_feed_date(spark):
    assert one(spark, dates.gkg_date, ["20240805121500", "2024", "notadate", None]) == [
        "2024-08-05T00:00:00Z", None, None, None]


def test_tone_of_missing_field_is_nan_not_zero(spark):
    got = one(spark, fields.parse_tone, ["-2.5,1,3", "abc,1", "", "1e1", None])
    assert got[:4] == [-2.5, 0.0, 0.0, 10.0] and math.isnan(got[4])


def test_keywords_are_substrings(spark):
    rows = [("FEDERAL_X", "http://a"), (None, "http://a/vote"), ("x", "http://a/tariff"), (None, None), ("trade", "war")]
    df = spark.createDataFrame(rows, "t string, u string")
    got = df.select(
        filters.mentions_joined(F.col("t"), F.col("u")), filters.mentions_either(F.col("t"), F.col("u"))
    ).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, True), (True, False), (False, False), (True, False)]


def test_words_are_unicode_aware(spark):
    values = ["a b", "a b　c", " \t\n", "", None, "x\x1fy\x85z"]
    assert one(spark, text.words, values) == [(v or "").split() for v in values]
    assert one(spark, text.word_count, values) == [len((v or "").split()) for v in values]


def test_unescape_goes_once_from_left_to_right(spark):
    cases = {"&amp;lt;": "&lt;", "&#233;&#xE9;": "éé", "a & b": "a & b", "&nosuch;": "&nosuch;", "&#0;x": "&#0;x", "&": "&",
             "&#55296;": "&#55296;", "&#128512;": "😀"}
    assert one(spark, text.unescape_html, list(cases)) == list(cases.values())


def test_strip_html(spark):
    cases = {
        "<p>a</p><p>b</p>": "ab", "x<script>var t='</p>';</script>y": "xy", "1 < 2": "1 < 2", "<!-- <b> -->z": "z",
        "<STYLE>p{}</STYLE>q": "q", "open <script>never closed": "open ", "<br/>&lt;i&gt;": "<i>",
    }
    assert one(spark, text.strip_html, list(cases)) == list(cases.values())


def test_clean_text(spark):
    cases = {
        "Don't stop <b>the</b> presses!": "stop press", "mail me@x.org see http://a.b/c now": "mail see",
        "well-known 2024 rates": "rate", "Cities, cities; boxes": "city city box", "cannot": "", "naïve café": "naïve café",
        "a I x": "", None: "", "": "", "U.S. economy.": "economy", "1,000 a,b": "b",
    }
    assert one(spark, text.clean_text, list(cases)) == list(cases.values())


def test_tokens_of_odd_texts_in_few_passes(spark):
    found = one(spark, text.clean_tokens, ["gold,, silver... iron--ore cannot", "tin:,5 x:, lead's gonna www.a.b c@d @brass", None])
    assert found == [["gold", "silver", "iron", "ore"], ["tin", "x", "lead", "gon", "na", "brass"], []]
    # Punctuation, pauses and clitics need a pattern; blanks are doubled without one.
    assert str(text.tokenize(F.col("v"))).count("regexp_replace") == 3


def test_long_word_costs_linear_time(spark):
    # Quadratic rescanning of such words would take minutes.
    assert one(spark, text.clean_text, ["x" * 300_000 + " httpx " + "<" * 100_000]) == ["x" * 300_000]
    assert one(spark, text.remove_emails, ["y" * 300_000]) == ["y" * 300_000]


def test_labels_and_composite(spark):
    rows = [("LABEL_0", 0.9), ("LABEL_1", 0.9), ("LABEL_2", 0.9), (None, None)]
    df = spark.createDataFrame(rows, "l string, s double")
    got = [r[0] for r in df.select(scores.signed_label_score(F.col("l"), F.col("s"))).collect()]
    assert got == [-0.9, 0.0, 0.9, 0.0]
    rows = [(19, 0.5), (20, 0.5), (20, 0.001), (20, 0.0011), (20, -0.5)]
    df = spark.createDataFrame([(" ".join(["w"] * n), m) for n, m in rows], "c string, m double")
    got = [r[0] for r in df.select(scores.composite_score(F.col("c"), F.col("m"), F.lit(0.1))).collect()]
    assert got == [0.1, 0.5, 0.1, 0.0011, -0.5]


def test_lexicon_rules(spark):
    def s(x):
        return round(x / math.sqrt(x * x + 15), 4)

    cases = {
        "good": s(1.9), "very good": s(1.9 + 0.293), "not good": s(1.9 * -0.74), "good but bad": s(1.9 * 0.5 - 2.5 * 1.5),
        "GOOD day": s(1.9 + 0.733), "good!!": s(1.9 + 2 * 0.292), "bad???": s(-2.5 - 0.54), "nothing here": 0.0, "": 0.0,
        "very big good": s(1.9 + 0.293 * 0.95), "!!!": 0.0, "barely good": s(1.9 - 0.293), "very bad": s(-2.5 - 0.293),
    }
    got = one(spark, lexicon.lexicon_score, list(cases))
    assert got == pytest.approx(list(cases.values()), abs=1e-4)
    assert one(spark, lexicon.lexicon_score, [None]) == [0.0]


def test_tail_of_t(spark):
    rows = [(2.228139, 10.0, 0.05), (4.302653, 2.0, 0.05), (1.962339, 1000.0, 0.05), (0.0, 5.0, 1.0), (-2.228139, 10.0, 0.05),
            (1.0, 1.0, 0.5), (1.959964, 1e7, 0.05)]
    df = spark.createDataFrame(rows, "t double, df double, p double")
    for r in df.select("p", stats.t_two_sided(F.col("t"), F.col("df")).alias("q")).collect():
        assert r["q"] == pytest.approx(r["p"], abs=1e-6)


def test_failing_text_does_not_spoil_its_batch(spark):
    def make():
        def score(texts):
            if any(t == "bad" for t in texts):
                raise ValueError
            return [("LABEL_2", 0.5) for _ in texts]
        return score

    got = one(spark, lambda c: scoring.batch_label_score(c, make), ["x", "bad", None, "y"])
    assert [(r["label"], r["score"]) for r in got] == [("LABEL_2", 0.5), (None, None), (None, None), ("LABEL_2", 0.5)]


def test_words_in_context_are_made_once(spark):
    """Each word is stripped once, and the words before it are not looked up one by one."""
    df = spark.createDataFrame([(1, 'He said: "not, in\tTHE (a) end!" ... x!'), (2, ""), (3, None), (4, "one"), (5, " a\n\nfew, ")], "doc_id long, text string")
    tokens = lexicon.token_table(df, "doc_id", "text")
    got = {}
    for r in sorted(tokens.collect()):
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for i, ws in {1: ["He", "said", "not", "in", "THE", "(a)", "end", "...", "x!"], 4: ["one"], 5: ["a", "few"]}.items():
        assert got.pop(i) == [(k, w, *[ws[k - j] if k >= j else None for j in (1, 2, 3)]) for k, w in enumerate(ws)]
    assert got == {}
    plan = tokens._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert tokens.dtypes == [("doc_id", "bigint"), ("pos", "int"), ("token", "string"), ("prev1", "string"), ("prev2", "string"), ("prev3", "string")]
