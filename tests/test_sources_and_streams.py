from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wherry.sources import jsonl
from wherry.streaming.politeness import fetch_times, new_urls


def test_tolerant_records(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"url": "u1", "file": "f"}\nnot json\n{"file": "g"}\n{"url": "u1", "file": "h", "more": 1}\n')
    assert [(r["url"], r["file"]) for r in jsonl.read_records(spark, str(tmp_path / "i.jsonl"), jsonl.URL_INDEX).collect()] == [("u1", "f"), ("u1", "h")]
    (tmp_path / "w.txt").write_text(" The \n\nA\nthe\n")
    assert {r["word"] for r in jsonl.read_words(spark, str(tmp_path / "w.txt")).collect()} == {"the", "a"}


def test_pages_and_index(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h/a.html").write_bytes("<p>学生</p>".encode())
    (tmp_path / "h/b.html").write_bytes("<p>学生</p>".encode("gb18030"))
    assert {r["html"] for r in jsonl.read_pages(spark, str(tmp_path / "h")).collect()} == {"<p>学生</p>"}
    built = []
    make = lambda at: built.append(1) or jsonl.write_bucketed(spark.createDataFrame([("b", 1), ("a", 2)], "term string, docid long"), at, "postings", 3, ["term"])
    path = str(tmp_path / "index")
    for remake in (False, False, True):
        assert jsonl.load_or_build(spark, path, ["postings"], make, lambda at: {"postings": jsonl.read_bucketed(spark, at, "postings", 3, ["term"])}, remake)["postings"].count() == 2
    assert len(built) == 2
    assert jsonl.decode_page('<meta charset="big5">學院'.encode("big5")).endswith("學院") and jsonl.decode_page("é".encode("utf-16")) == "é" and jsonl.decode_page(b"\xff\xff<meta charset=nonsense>")


def test_fingerprint_changes_with_files(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    first = jsonl.fingerprint(spark, [str(tmp_path)])
    assert first == jsonl.fingerprint(spark, [str(tmp_path)])
    (tmp_path / "b").write_text("yy")
    assert first != jsonl.fingerprint(spark, [str(tmp_path)])


def run(spark, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def source(spark, tmp_path, rows):
    spark.createDataFrame(rows, "url string, at timestamp").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("url string, at timestamp").parquet(str(tmp_path / "in"))


def test_politeness(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(f"http://a.example/{k}", start + timedelta(seconds=k)) for k in range(4)] + [("http://b.example/", start), (None, start)]
    got = run(spark, fetch_times(source(spark, tmp_path, rows), 5.0), "polite")
    times = sorted(r["fetch_at"] for r in got if r["host"] == "a.example")
    assert [(t - times[0]).total_seconds() for t in times] == [0, 5, 10, 15] and len(got) == 5


def test_new_urls(spark, tmp_path):
    rows = [("u", datetime(2024, 1, 1)), ("u", datetime(2024, 1, 1, 1)), ("v", datetime(2024, 1, 1))]
    assert {r["url"] for r in run(spark, new_urls(source(spark, tmp_path, rows)), "fresh")} == {"u", "v"}
    assert F.lit(1) is not None


def test_written_tables(spark):
    from wherry.session import written

    rows = spark.createDataFrame([(1, [2], None), (None, [], "x")], "a long, b array<int>, c string")
    got = written(rows)
    assert got.schema == rows.schema and sorted(map(str, got.collect())) == sorted(map(str, rows.collect())) and written(rows.limit(0)).count() == 0
