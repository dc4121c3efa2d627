import json
import struct
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import images as K
from glyphmill.plans import catalogue, more  # noqa: F401
from glyphmill.sources import readers as S
from glyphmill.sources import synthetic, writers
from glyphmill.streaming import logs


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def png(height, width, value):
    raw = b"".join(b"\0" + bytes([value(y, x) for x in range(width)]) for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_iam(spark, tmp_path):
    path = write(tmp_path / "lines.txt", "# c\n\na01-000u-00 ok 154 19 408 746 1661 89 A|MOVE|to|stop\na01-000u-01 err 1 2 3 4 5 6 x\nshort ok\n")
    r = S.iam_lines(spark, path).collect()
    assert [(x.line_id, x.form_id, x.writer_id, x.text) for x in r] == [("a01-000u-00", "a01-000u", "a01", "A MOVE to stop")]
    assert S.iam_lines(spark, path, spark.createDataFrame([("b",)], "form_id string")).count() == 0
    words = write(tmp_path / "words.txt", "a01-000u-00-00 ok 154 408 768 27 51 AT A\n")
    assert [(x.line_id, x.text) for x in S.iam_words(spark, words).collect()] == [("a01-000u-00", "A")]


def test_labels(spark, tmp_path):
    a = write(tmp_path / "a.json", json.dumps([{"filename": "x.png", "label": "t"}, {"image": "", "text": "u"}]))
    b = write(tmp_path / "b.csv", "filename,label\ny.png,v\n,w\n")
    c = write(tmp_path / "c.jsonl", '{"image_path": "z.png", "ground_truth_text": "q"}\n')
    assert [tuple(r) for p in (a, b, c) for r in S.labels(spark, p).collect()] == [("x.png", "t"), ("y.png", "v"), ("z.png", "q")]


def test_positional_formulas(spark, tmp_path):
    f = S.numbered_lines(spark, write(tmp_path / "f.lst", "a\nb\nc\n"))
    s = S.formula_split(spark, write(tmp_path / "s.lst", "2 img basic\n9 out basic\n0 i0.png basic\n"), f)
    assert sorted((r.idx, r.image, r.latex) for r in s.collect()) == [(0, "i0.png", "a"), (2, "img.png", "c")]


def test_stems(spark, tmp_path):
    write(tmp_path / "i" / "0001-1-1.png", b"x")
    write(tmp_path / "i" / "0002-1-1.png", b"x")
    t = write(tmp_path / "t.txt", "0001-1-1\tfirst\n0001-1-1\tlast\n0002-1-1\t \n0003-1-1\tno image\n")
    assert [(r.writer_id, r.text) for r in S.transcribed_images(spark, t, str(tmp_path / "i")).collect()] == [("0001", "last")]
    write(tmp_path / "b" / "0001-1-1.txt", " some text \n")
    write(tmp_path / "b" / "0009.txt", " ")
    assert [r.text for r in S.text_files(spark, str(tmp_path / "b"), str(tmp_path / "i")).collect()] == ["some text"]


def test_coco(spark, tmp_path):
    doc = {"categories": [{"id": 1, "name": "text"}], "images": [{"id": 7, "file_name": "a"}, {"id": 8, "file_name": "b"}], "annotations": [{"image_id": 7, "category_id": 1, "bbox": [1, 2, 3, 4]}, {"image_id": 7, "category_id": 5, "bbox": [0, 0, 1, 1]}]}
    got = {r.image_id: [(b.class_name, b.x2, b.y2) for b in r.boxes] for r in S.coco(spark, write(tmp_path / "c.json", json.dumps(doc))).collect()}
    assert got == {7: [("text", 4, 6), ("unknown", 1, 1)], 8: []}


def test_ink(spark, tmp_path):
    write(tmp_path / "k" / "a.inkml", '<ink xmlns="http://www.w3.org/2003/InkML"><annotation type="truth">x^2</annotation><trace>1 2, 3 4, z</trace></ink>')
    write(tmp_path / "k" / "b.inkml", "<ink><trace>1 2")
    got = {r.path[-7:]: (r.latex, r.traces and [[tuple(p) for p in t] for t in r.traces]) for r in S.ink(spark, str(tmp_path / "k")).collect()}
    assert got == {"a.inkml": ("x^2", [[(1, 2), (3, 4)]]), "b.inkml": (None, None)}


def test_lexicons(spark, tmp_path):
    for name, text in (("a.json", '["B","a"]'), ("b.json", '{"words": ["B", "a"]}'), ("c.txt", "B\na\n\n")):
        assert sorted(r.word for r in S.lexicon(spark, write(tmp_path / name, text)).collect()) == ["a", "b"]


def test_pictures(spark, tmp_path):
    write(tmp_path / "p" / "a.png", png(40, 30, lambda y, x: 0 if 10 <= y < 20 else 255))
    write(tmp_path / "p" / "b.png", b"no picture")
    rows = {r.origin[-5:]: r for r in K.features(S.images(spark, str(tmp_path / "p"))).collect()}
    assert rows["a.png"].line_count == 1 and rows["a.png"].profile == "clean" and rows["b.png"].mean is None


def test_writers(spark, tmp_path):
    df = synthetic.samples(spark, 50)
    writers.manifest(df, str(tmp_path / "m"))
    back = S.manifest(spark, str(tmp_path / "m"))
    assert back.count() == 50 and {r[0] for r in back.select("mode").distinct().collect()} == {"text", "math", "mixed"}
    writers.training_manifest([back.drop("partition")], str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).groupBy("partition").count().count() == 3
    writers.lexicon(spark.createDataFrame([("b",), ("a",)], "word string"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first().value == '["a","b"]'
    assert synthetic.formulas(spark, 5).count() == 5 and synthetic.layout_labels(spark, 3).count() == 15


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), (F.col("id") % 5).alias("user_id"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    batch = logs.stage_windows(spark.read.parquet(str(tmp_path / "in")))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = logs.stage_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.collect()))
    assert logs.session_runs(spark.read.parquet(str(tmp_path / "in"))).count() > 0


def test_jobs(spark, tmp_path):
    write(tmp_path / "jobs" / "a.txt", "one")
    q = logs.process_jobs(logs.job_files(spark, str(tmp_path / "jobs")), lambda b: b.select("path", F.length("content").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).first().n == 3
    ids = lambda rows, schema: spark.createDataFrame(rows, schema)
    states = logs.job_states(ids([(1,), (2,), (3,), (4,)], "job_id int"), ids([(1, 5.0), (2, 700.0), (3, 1.0)], "job_id int, seconds double"), ids([(3, None)], "job_id int, error string"))
    assert {r.job_id: r.state for r in states.collect()} == {1: "processing", 2: "failed", 3: "completed", 4: "queued"}


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_log_lines_round_ties_as_the_statement_does(spark, tmp_path, zone):
    """Elapsed times halfway between two milliseconds, and a night in which the session's clock is put forward."""
    con = duckdb.connect()
    con.execute("create table events as select k as event_id, timestamp '2024-03-31 01:30:00.25' + to_microseconds(62500 * k) + to_hours(k::int) as ts, 7 as user_id, 'view' as event_type from range(32) r(k)")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = sorted(tuple(r) for r in catalogue.QUERIES["log_file"](spark, str(tmp_path)).select("line", "n").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert got == sorted(con.execute(f"select line, n from ({catalogue.ORACLE['log_file']})").fetchall())
