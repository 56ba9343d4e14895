"""Feed files, archives, pages, streams, tables and the stages in a row."""

import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewire import session
from tidewire.operators import topics
from tidewire.operators.scoring import apply_default_scorer, default_scorer
from tidewire.plans.collect import MANY, collect_bulk, collect_landed
from tidewire.plans.nlp import score_articles
from tidewire.plans.run import run_stages
from tidewire.plans.topics import model_topics
from tidewire.queries import load
from tidewire.sinks import writers
from tidewire.sources import archives, feeds, gkg, pages, slots, tables
from tidewire.streaming.ingest import bounded_stream, ingest_stream, ingested, line_stream


def line(url, themes="vote", n=27, date="20240805101500", tone="1.5,2"):
    parts = [""] * n
    for i, v in ((0, date), (3, "src"), (4, url), (7, themes), (15, tone)):
        if i < n:
            parts[i] = v
    return "\t".join(parts)


def test_line_shapes(spark, tmp_path):
    text = "\n".join([
        line("http://a"), line("http://b", n=30), line("http://c", n=5), "", line("NA", themes="null"), line('http://"d', themes='"open'),
    ])
    (tmp_path / "x.txt").write_bytes(text.encode() + b"\n" + line("http://e\xff".encode("latin1").decode("latin1")).encode("latin1"))
    got = {r["url"]: r for r in gkg.read_gkg(spark, str(tmp_path)).collect()}
    assert set(got) == {"http://a", "http://b", "http://c", None, 'http://"d', "http://e�"}
    assert got["http://c"]["themes"] is None and got["http://c"]["tone_csv"] is None
    assert got[None]["themes"] is None and got["http://b"]["tone_csv"] == "1.5,2"


def test_zipped_files(spark, tmp_path):
    for name, lines in (("a", ["http://a1", "http://a2"]), ("b", ["http://b1"])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("first.csv", "\n".join(line(u) for u in lines))
            z.writestr("second.csv", line("http://never"))
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    (tmp_path / "empty.zip").write_bytes(empty.getvalue())
    rows = archives.read_zipped_gkg(spark, str(tmp_path)).collect()
    assert {(r["line_no"], r["url"]) for r in rows} == {(0, "http://a1"), (1, "http://a2"), (0, "http://b1")}


@pytest.mark.parametrize("zipped", [False, True])
def test_only_listed_slots_are_read(spark, tmp_path, zipped):
    end = ".gkg.csv.zip" if zipped else ".gkg.csv"
    for i, name in enumerate(("20240805101500", "20240805100000", "20240805094500")):
        text = "\n".join([line(f"http://{i}a"), "", line(f"http://{i}b"), line(f"http://{i}c")])
        if zipped:
            with zipfile.ZipFile(tmp_path / f"{name}{end}", "w") as z:
                z.writestr("first.csv", text)
        else:
            (tmp_path / f"{name}{end}").write_text(text)
    listed = spark.createDataFrame([(0, "20240805101500"), (1, "20240805094500"), (2, "20240805093000")], "file_no int, slot string")
    rows = gkg.read_slots(spark, str(tmp_path), listed, "{slot}" + end)
    assert {f.rsplit("/", 1)[1][:14] for f in rows.inputFiles()} == {"20240805101500", "20240805094500"}
    got = [(r["slot"], r["url"]) for r in rows.orderBy("slot", "line_no").collect()]
    assert got == [("20240805094500", f"http://2{c}") for c in "abc"] + [("20240805101500", f"http://0{c}") for c in "abc"]
    assert gkg.read_slots(spark, str(tmp_path), listed.filter("file_no = 2"), "{slot}" + end).count() == 0
    assert gkg.read_slots(spark, str(tmp_path), listed.limit(0), "{slot}" + end).count() == 0


def test_line_numbers_grow_over_splits(spark, tmp_path):
    (tmp_path / "s1.csv").write_text("\n".join(line(f"http://{i}") for i in range(3000)))
    (tmp_path / "s2.csv").write_text(line("http://x"))
    listed = spark.createDataFrame([(0, "s1"), (1, "s2")], "file_no int, slot string")
    for option, value in (("maxPartitionBytes", "9000"), ("openCostInBytes", "1")):
        spark.conf.set(f"spark.sql.files.{option}", value)
    try:
        rows = gkg.read_slots(spark, str(tmp_path), listed, "{slot}.csv").filter("slot = 's1'")
        assert rows.rdd.getNumPartitions() > 8
        assert [r["url"] for r in rows.orderBy("line_no").collect()] == [f"http://{i}" for i in range(3000)]
    finally:
        for option in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{option}")


@pytest.mark.parametrize("target", [None, 1, 5, 9, 1000])
def test_groups_of_slots_equal_one_read(spark, tmp_path, target):
    for i in range(7):
        urls = [f"http://{(i * 3 + j) % 11}" for j in range(4)]
        (tmp_path / f"s{i}.csv").write_text("\n".join(line(u) for u in urls))
    listed = spark.createDataFrame([(i, f"s{i}") for i in range(9)], "file_no int, slot string")
    got, counts = collect_landed(spark, str(tmp_path), listed, target, layout="{slot}.csv", first_group=2)
    lines = gkg.read_slots(spark, str(tmp_path), listed, "{slot}.csv")
    whole, counted = collect_bulk(lines, listed, MANY if target is None else target)
    pick = lambda df: sorted((r["url"], r["file_no"]) for r in df.collect())
    assert pick(got) == pick(whole) and counts.first().asDict() == counted.first().asDict()
    none, zero = collect_landed(spark, str(tmp_path), listed.limit(0), target, layout="{slot}.csv")
    assert none.count() == 0 and zero.first()["files_tried"] == 0


def test_topics_do_not_shuffle_bodies(spark):
    docs = spark.createDataFrame([(i, "tax vote" if i % 2 else "rain storm", "") for i in range(40)], "seq long, cleaned_body string, headline string")
    rows = model_topics(docs.withColumn("body", F.lit("long")), k=2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert {r["topic"].split("_", 2)[2] for r in rows.collect()} == {"rain_storm", "tax_vote"}


def test_slots(spark):
    now = spark.createDataFrame([(datetime(2024, 8, 5, 10, 20, 30),)], "now timestamp")
    got = [r["slot"] for r in slots.recent_slots(now, F.col("now"), 3).orderBy("file_no").collect()]
    assert got == ["20240805101500", "20240805100000", "20240805094500"]
    got = slots.window_slots(tables.define_windows(spark))
    assert got.count() == 85 + 85 + 85 and got.agg(F.max("slot")).first()[0] == "20241115000000"


def test_feed_answers(spark):
    b = [{"articles": [{"url": "u1", "source": {"name": "N"}}, {"url": "u2", "source": {}}, {"url": "u3", "source": None}]}, {"status": "x"}]
    df = spark.createDataFrame([(json.dumps(x),) for x in b], "body string")
    rows = feeds.feed_b_records(feeds.feed_b_articles(df)).collect()
    assert {(r["url"], r["source"]) for r in rows} == {("u1", "N"), ("u2", None), ("u3", "Unknown")}
    assert feeds.feed_a_articles(df).count() == 3


def test_page_text(spark):
    html = "<html><head><title>A &amp; B</title><style>x</style></head><body><nav>menu</nav><p>one</p><p>two</p><script>1<2</script></body>"
    row = pages.scrape(spark.createDataFrame([(html,), (None,)], "html string")).orderBy(F.desc("html")).collect()
    assert (row[0]["headline"], row[0]["body"]) == ("A & B", "one two")
    assert (row[1]["headline"], row[1]["body"]) == ("", "")
    lengths = spark.createDataFrame([("x" * 100,), ("x" * 101,)], "b string")
    assert lengths.filter(pages.long_enough(F.col("b"))).count() == 1


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    src, dst, ckpt = (str(tmp_path / n) for n in ("src", "dst", "ckpt"))
    (tmp_path / "src").mkdir()

    def run():
        ingest_stream(spark, src, dst, ckpt).awaitTermination()
        return sorted(r["url"] for r in ingested(spark, dst).collect())

    (tmp_path / "src" / "1.txt").write_text("\n".join([line("http://a"), line("http://b"), line("http://a"), line("http://no", "sport")]))
    assert run() == ["http://a", "http://b"]
    assert run() == ["http://a", "http://b"]
    (tmp_path / "src" / "2.txt").write_text("\n".join([line("http://b"), line("http://c"), line("ftp://d")]))
    assert run() == ["http://a", "http://b", "http://c"]


def test_bounded_stream(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "20240805101500.txt").write_text("\n".join([line("http://a"), line("http://a"), line("http://b")]))
    at = F.to_timestamp(F.substring("file", 1, 14), "yyyyMMddHHmmss")
    query = (
        bounded_stream(line_stream(spark, str(tmp_path / "src")), at).writeStream.format("memory").queryName("bounded")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r["url"] for r in spark.table("bounded").collect()) == ["http://a", "http://b"]


def test_json_array_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"url": "u", "body": "b", "gdelt_tone": 1.5}, {"url": "v"}], indent=2))
    rows = tables.read_articles_json(spark, str(tmp_path), array=True).orderBy("url").collect()
    assert [(r["url"], r["body"], r["gdelt_tone"]) for r in rows] == [("u", "b", 1.5), ("v", None, None)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", all', 1), ("x\ny", 2)], "t string, n int")
    writers.write_csv(df, str(tmp_path / "c"), single_file=True)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert {r["t"] for r in back.collect()} == {'say "hi", all', "x\ny"}


def test_small_topic_inputs(spark):
    docs = spark.createDataFrame([(1, "", "head line")], "seq long, cleaned_body string, headline string")
    assert [(r["topic_id"], r["topic"]) for r in model_topics(docs).collect()] == [(-1, "Topic_-1")]
    assert model_topics(docs.limit(0)).count() == 0


def test_topic_properties(spark):
    words = ["bank rate cut", "bank rate rise", "vote poll party", "vote party seat", "rain storm wind", "rain wind cold"] * 3
    docs = spark.createDataFrame([(i, w, "") for i, w in enumerate([*words, "zebra"])], "seq long, cleaned_body string, headline string")
    rows = model_topics(docs, k=4).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["topic_id"], []).append(r["topic"])
    real = sorted(k for k in sizes if k >= 0)
    assert real == list(range(len(real))) and len(rows) == 19
    counts = [len(sizes[k]) for k in real]
    assert counts == sorted(counts, reverse=True) and min(counts) >= 2
    assert all(set(sizes[k]) == {sizes[k][0]} and sizes[k][0].startswith(f"Topic_{k}_") for k in real)
    assert set(sizes.get(-1, ["Outlier"])) == {"Outlier"}


def test_topic_numbers_and_labels(spark):
    df = spark.createDataFrame([(c,) for c in [5, 5, 5, 7, 7, 9, None]], "c int")
    got = {(r["c"], r["topic_id"]) for r in topics.number_topics(df, "c").collect()}
    assert got == {(5, 0), (7, 1), (9, -1), (None, -1)}


def test_all_stages_twice(spark, tmp_path):
    def scorer():
        return lambda texts: [("LABEL_2", 0.8) for _ in texts]

    body = " ".join(f"growth{chr(97 + i % 26)} market{chr(97 + i // 5)}" for i in range(60))
    urls = [f"http://h/{i}" for i in range(12)]
    lines = spark.createDataFrame(
        [("s", i, f"202408{i % 9 + 1:02d}", "src", u, "vote", "1,2") for i, u in enumerate(urls)],
        "slot string, line_no long, date string, source string, url string, themes string, tone_csv string",
    )
    html = [(u, f"<title>Good day {i}</title><p>{body} {' '.join(chr(97 + i) * k for k in range(2, 40))}</p>") for i, u in enumerate(urls)]
    found = spark.createDataFrame(html[:11], "url string, html string")
    spark.sql("CREATE DATABASE IF NOT EXISTS flow")
    for _ in range(2):
        counters = run_stages(
            spark, ["collect", "clean", "nlp", "topic", "export"], str(tmp_path), lines=lines,
            slots=spark.createDataFrame([(0, "s")], "file_no int, slot string"), pages=found, scorer=scorer,
            events=spark.createDataFrame([("e", "2024-08-05")], "event_name string, event_date string"), k=2, database="flow",
        )
        assert counters["collect"] == {"total": 12, "files_tried": 1} and counters["scrape"] == {"scraped": 11, "failed": 1}
        assert counters["clean"]["initial"] == 11
        assert counters["clean"]["final"] == spark.table("flow.articles").count()
        assert spark.table("flow.event_analysis").count() == 1
        assert spark.read.option("header", True).csv(f"{tmp_path}/export/events").first()["event_name"] == "e"
    with pytest.raises(ValueError):
        run_stages(spark, ["nonsense"], str(tmp_path))


def test_scores_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "the body", "good"), (2, None, None)], "seq long, body string, headline string")
    scored = score_articles(docs, lambda: lambda texts: [("LABEL_0", 0.9) for _ in texts])
    rows = {r["seq"]: r for r in scored.collect()}
    assert rows[1]["transformer_score"] == -0.9 and rows[1]["sentiment_score"] == rows[1]["vader_score"] > 0
    assert rows[2]["transformer_score"] == 0.0 and rows[2]["cleaned_body"] == ""
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_bundled_model_reads_whole_texts(spark):
    # What tells the labels apart comes after 2,500 characters that are the same in all texts.
    rows = [(i, "plain words " * 210 + ("splendid " if i % 2 else "dreadful ") * 20, i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "seq long, text string, label int")
    model = default_scorer(docs, "text", "label")
    found = {r.seq: r for r in score_articles(docs.select("seq", F.col("text").alias("body"), F.lit(None).cast("string").alias("headline")), model).collect()}
    assert all((found[i].transformer_score > 0.5) == bool(y) and abs(found[i].transformer_score) > 0.5 for i, _, y in rows)
    scored = load()[0]["ml2_model_score"](spark, "/root/testdata/sf0.001")
    assert "substring(text" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_word_counts_are_made_once(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "i int, _tokens array<string>")
    counted = topics.hashed_counts(docs).drop("_tokens")
    found = {r.i: r.vector.norm(2) for r in topics.fit_tfidf(counted, "text", out="vector")(counted).collect()}
    assert found == {1: pytest.approx(1), 2: 0}
    weights = topics.term_weights(docs, "i", "_tokens")
    assert weights.count() == 3 and weights.inputFiles()


def test_bundled_model_scores_after_an_observed_write(spark, tmp_path):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(str(tmp_path / "observed"))
    assert seen.get["n"] == 3
    docs = spark.createDataFrame([(i, "splendid words" if i % 2 else "dreadful words", i % 2) for i in range(8)], "seq long, text string, target int")
    found = apply_default_scorer(default_scorer(docs, "text", "target"), docs.select("seq", "text"), "text").collect()
    assert {r.seq: r.label for r in found} == {i: "LABEL_2" if i % 2 else "LABEL_0" for i in range(8)}


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir", spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    cut = session.cut_lineage(spark.range(3))
    assert cut.count() == 3 and cut.inputFiles()[0].replace("file://", "").startswith(session.shared_dir(spark))
