"""The sharded URL store, runs that are cut off, and zipped archives as a data source."""

import os
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewire.plans.collect import collect_resumable
from tidewire.sinks.store import UrlStore
from tidewire.sources import archives
from tidewire.streaming.ingest import archive_line_stream, ingest_stream, ingested

ROW = "url string, n long"


def urls(spark, *names):
    return spark.createDataFrame([(u, i) for i, u in enumerate(names)], ROW)


def slots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "slot string")


def stored(store):
    return sorted((r.url, r.batch) for r in store.read(ROW).collect())


def test_each_url_once_over_batches(spark, tmp_path):
    store = UrlStore(spark, str(tmp_path / "s"), shards=4)
    assert stored(store) == [] and store.next_batch() == 0 and store.finished().count() == 0
    store.append(urls(spark, "a", "b", None), slots=slots(spark, "1"))
    store.append(urls(spark, "b", "c"), slots=slots(spark, "2", "3"))
    store.append(urls(spark), slots=slots(spark, "4"))
    store.append(urls(spark, "a", "d"), slots=slots(spark, "5"))
    assert stored(store) == [("a", 0), ("b", 0), ("c", 1), ("d", 3)]
    assert sorted(r.slot for r in store.finished().collect()) == list("12345")


def test_batch_that_was_cut_off_is_not_seen_and_written_over(spark, tmp_path):
    store = UrlStore(spark, str(tmp_path / "s"), shards=4)
    store.append(urls(spark, "a"), slots=slots(spark, "1"))
    store.append(urls(spark, "x", "b"), 1)  # its slots are never recorded
    assert stored(store) == [("a", 0)] and store.next_batch() == 1
    store.append(urls(spark, "b", "c"), slots=slots(spark, "2"))
    assert stored(store) == [("a", 0), ("b", 1), ("c", 1)]
    store.append(urls(spark, "b", "d"), 1, slots(spark, "2"))  # a batch run again replaces itself
    assert stored(store) == [("a", 0), ("b", 1), ("d", 1)]


def test_only_the_shards_of_a_batch_are_read(spark, tmp_path):
    store = UrlStore(spark, str(tmp_path / "s"), shards=8)
    store.append(urls(spark, *[f"u{i}" for i in range(100)]), slots=slots(spark, "1"))
    one = store.known([3], 1, store.read(ROW).schema)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*shard#\d+ = 3", plan) and "ReadSchema: struct<url:string>" in plan
    assert one.inputFiles() and all("/shard=3/" in f or "shard=" in f for f in one.inputFiles())
    wanted = spark.range(100).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    assert one.count() == wanted.filter(store.shard_of(F.col("url")) == 3).count()


def feed_line(url):
    parts = [""] * 27
    parts[0], parts[3], parts[4], parts[7] = "20240805101500", "src", url, "vote"
    return "\t".join(parts)


@pytest.mark.parametrize("stop_after", [0, 1, 2, 3])
def test_resumed_runs_equal_one_run(spark, tmp_path, stop_after):
    for i in range(7):
        (tmp_path / f"s{i}.csv").write_text("\n".join(feed_line(f"http://{(i * 3 + j) % 11}") for j in range(4)))
    listed = spark.createDataFrame([(i, f"s{i}") for i in range(9)], "file_no int, slot string")
    whole, parts = (UrlStore(spark, str(tmp_path / n), shards=3) for n in ("whole", "parts"))
    schema = "file_no int, line_no long, url string"
    args = {"layout": "{slot}.csv", "slots_per_batch": 2}
    assert collect_resumable(spark, str(tmp_path), listed, whole, **args) == 5
    assert collect_resumable(spark, str(tmp_path), listed, parts, max_batches=stop_after, **args) == stop_after
    assert collect_resumable(spark, str(tmp_path), listed, parts, **args) == 5 - stop_after
    assert collect_resumable(spark, str(tmp_path), listed, parts, **args) == 0
    rows = lambda s: sorted((r.url, r.file_no) for r in s.read(schema).collect())
    assert rows(whole) == rows(parts) and len(rows(whole)) == 11


# --- archives -----------------------------------------------------------------------------------------


def archive(path, text, at=None):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("first.csv", text)
        z.writestr("second.csv", "never")
    if at is not None:
        os.utime(path, (at, at))


def lines(df):
    return sorted((r.path.rsplit("/", 1)[1], r.line_no, r.value) for r in df.collect())


def test_lines_of_archives(spark, tmp_path, monkeypatch):
    archive(tmp_path / "a.zip", "one\r\n\ntwo\xe9\nlast")
    archive(tmp_path / "b.zip", b"bad \xff byte\n")
    archive(tmp_path / "c.zip", "")
    long = [f"{i} " + "x" * 50 for i in range(45_000)]  # more than one block, and more than one batch
    archive(tmp_path / "d.zip", "\n".join(long) + "\n")
    (tmp_path / "e.txt").write_text("no archive")
    found = archives.read_archives(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 4
    rows = lines(found)
    assert rows[:4] == [("a.zip", 0, "one"), ("a.zip", 1, ""), ("a.zip", 2, "two\xe9"), ("a.zip", 3, "last")]
    assert rows[4] == ("b.zip", 0, "bad � byte") and [r[2] for r in rows[5:]] == long
    assert lines(archives.read_archives(spark, str(tmp_path), ["b.zip", "none.zip"])) == rows[4:5]
    assert archives.read_archives(spark, f"file://{tmp_path}", []).count() == 0


def test_damaged_archives(spark, tmp_path):
    archive(tmp_path / "good.zip", "x")
    archive(tmp_path / "cut.zip", "\n".join(f"{i * 7919 % 10007}" for i in range(50_000)))
    content = bytearray((tmp_path / "cut.zip").read_bytes())
    content[len(content) // 2] ^= 255
    (tmp_path / "cut.zip").write_bytes(bytes(content))
    (tmp_path / "none.zip").write_bytes(b"no archive")
    assert lines(archives.read_archives(spark, str(tmp_path))) == [("good.zip", 0, "x")]
    with pytest.raises(Exception, match="damaged archive|incorrect|invalid|Bad CRC"):
        archives.read_archives(spark, str(tmp_path), damaged="fail").count()


def test_stream_of_archives(spark, tmp_path):
    src, dst, ckpt = (str(tmp_path / n) for n in ("src", "dst", "ck"))
    os.mkdir(src)

    def run():
        ingest_stream(spark, src, dst, ckpt, zipped=True, shards=4).awaitTermination()
        return sorted(r.url for r in ingested(spark, dst, 4).collect())

    archive(f"{src}/1.zip", feed_line("http://a") + "\n" + feed_line("http://b"), 1000)
    assert run() == ["http://a", "http://b"]
    assert run() == ["http://a", "http://b"]
    archive(f"{src}/0.zip", feed_line("http://b") + "\n" + feed_line("http://c") + "\n", 2000)
    assert run() == ["http://a", "http://b", "http://c"]
    assert archive_line_stream(spark, src).isStreaming
