import pytest
from pyspark.sql import functions as F

from glyphmill.functions import distance as D
from glyphmill.operators import decoding, documents, images, layout, lexicon, lines, manifest, metrics, recognizers, spans
from glyphmill.plans import catalogue, more  # noqa: F401


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "page_id long, pos int, x1 int, y1 int, x2 int, y2 int, class_id int, confidence double")


def test_merge_broken_lines(spark):
    rows = ["We obtain", "x = 2.", "", "Proof:", "by integration"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "g int, pos int, text string")
    assert [r.text for r in lines.merge_broken(df, "g", "pos").orderBy("island").collect()] == ["We obtain x = 2.", "Proof:", "by integration"]


def test_running_mean_lines(spark):
    df = boxes(spark, [(0, y - 1, 9, y + 1, 0, 1.0) for y in (1, 15, 30, 60, 70)])
    got = {r.pos: r.line_no for r in layout.line_numbers(df, 20).collect()}
    assert [got[i] for i in range(5)] == [0, 0, 1, 2, 2]


def test_merge_close(spark):
    df = boxes(spark, [(0, 0, 10, 5, 1, 0.5), (25, 0, 40, 5, 1, 0.9), (70, 0, 80, 5, 1, 0.4)])
    got = sorted((r.x1, r.x2, r.confidence) for r in layout.merge_close(df).collect())
    assert got == [(0, 40, 0.9), (70, 80, 0.4)]


def test_suppress(spark):
    df = boxes(spark, [(0, 0, 10, 10, 1, 0.9), (0, 0, 10, 9, 2, 0.8), (50, 50, 60, 60, 1, 0.3), (0, 0, 10, 4, 1, 0.7)])
    assert sorted(r.pos for r in layout.suppress(df, 0.45, 0.2).collect()) == [0, 2, 3]


def test_cluster_lines(spark):
    df = boxes(spark, [(0, 0, 9, 10, 1, 1.0), (20, 4, 29, 14, 1, 1.0), (0, 30, 9, 40, 1, 1.0)])
    got = {r.pos: r.line_no for r in layout.cluster_lines(df).collect()}
    assert got == {0: 0, 1: 0, 2: 1}


def test_documents_from_boxes(spark):
    rows = [(1, 0, 10, 0, 50, 20, "Hello", "text", False), (1, 1, 60, 2, 90, 22, "x^2", "math", False), (1, 2, 10, 60, 80, 80, "Next", "text", False)]
    df = spark.createDataFrame(rows, "page_id long, pos int, x1 int, y1 int, x2 int, y2 int, text string, kind string, display boolean")
    assert layout.documents(df).first().document == "Hello $x^2$\n\nNext"


def test_lexicon(spark):
    words = spark.createDataFrame([("equation",), ("equity",), ("eel",)], "word string")
    got = lexicon.similar(spark.createDataFrame([("equatoin",), (None,)], "query string"), words, 2).collect()
    assert [(r.word, r.distance) for r in got] == [("equation", 2)]
    assert [r.word for r in lexicon.with_prefix(spark.createDataFrame([("eq",)], "query string"), words).orderBy("place").collect()] == ["equation", "equity"]
    texts = spark.createDataFrame([(1, "(Equatio, eel!"), (2, "")], "id int, text string")
    assert {r.id: r.corrected for r in lexicon.correct(texts, words, "id").collect()}[1] == "(Equation, eel!"
    score = {r.id: r.score for r in lexicon.coverage(texts, words, "id").collect()}
    assert score[2] == 1 and 0 < score[1] < 1


def test_upper_median_and_summary(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "v double")
    assert metrics.upper_median(df, [], "v").first().median == 3
    pairs = spark.createDataFrame([("abc", "abc"), ("a", "abc")], "prediction string, reference string")
    got = metrics.corpus_summary(metrics.pairs_with_rates(pairs)).first()
    assert got.exact_rate == 0.5 and got.n == 2 and got.median_cer == pytest.approx(2 / 3)
    assert metrics.batch_summary(metrics.pairs_with_rates(pairs.limit(1))).first().std_cer == 0
    assert metrics.corpus_summary(metrics.pairs_with_rates(pairs.limit(0))).first().mean_cer == 0
    assert metrics.math_summary(pairs).first().edits == 2


def test_engines(spark):
    df = spark.createDataFrame([(1, "abc", {"a": "abc", "b": "x"}), (2, "de", {"a": "de"})], "sample_id int, reference string, predictions map<string,string>")
    out = metrics.compare_engines(df)
    assert metrics.best(out, "engine", "mean_cer").first().engine == "a"
    assert metrics.report(out).first().report.splitlines()[2].startswith("| a | 0.0000")


@pytest.mark.parametrize("cumulative,sizes", [(False, (5, 0, 2)), (True, (5, 1, 1))])
def test_split(spark, cumulative, sizes):
    rows = manifest.split(spark.range(7).withColumnRenamed("id", "k"), "k", (0.8, 0.1), cumulative=cumulative).groupBy("partition").count().collect()
    got = {r.partition: r["count"] for r in rows}
    assert tuple(got.get(n, 0) for n in ("train", "val", "test")) == sizes


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    kids = spark.createDataFrame([(1, 2), (1, 1), (9, 3)], "k int, c int")
    got = {r.k: [i.c for i in r["items"]] for r in manifest.with_group(a, kids, "k", ["c"], ["c"]).collect()}
    assert got == {1: [1, 2], 2: []}
    assert manifest.keep_listed(a, kids.limit(0), "k").count() == 2
    assert manifest.keep_listed(a, kids, "k").count() == 1
    with pytest.raises(ValueError):
        manifest.checked_zip(a, kids, "k")


def test_nested_documents(spark):
    rows = [("d", 1, 0, "text", "a", "", 0.9, [0, 0, 1, 1]), ("d", 2, 0, "equation", "b", "x", 0.8, [0, 0, 1, 1])]
    df = spark.createDataFrame(rows, "document_id string, page_number int, pos int, kind string, raw_text string, latex string, confidence double, bounding_box array<int>")
    r = documents.documents(df).first()
    assert [b.latex for p in r.pages for b in p.blocks] == ["a", "x"] and r.metadata.subject == "unknown"
    assert documents.to_json(documents.documents(df)).first().json.startswith('{"document_id":"d"')
    assert spark.range(1).select(documents.steps_of(F.lit('["a","b"]')).alias("v")).first().v == ["a", "b"]
    assert spark.range(1).select(documents.front_matter(F.lit("t"), F.create_map(F.lit("k"), F.lit("v"))).alias("v")).first().v == "---\nk: v\n---\n\nt"


def test_recognizers(spark):
    def failing():
        def run(items):
            if items[0] == b"bad":
                raise RuntimeError("no")
            return [(items[0].decode().upper(), 0.9)]

        return run

    df = spark.createDataFrame([(1, b"ok"), (2, b"bad"), (3, b"ok")], "id int, data binary")
    got = {r.id: (r.text, r.error) for r in recognizers.recognize_once(df, failing, name="t").collect()}
    assert got[1] == ("OK", None) and got[2][1] == "RuntimeError: no" and got[3] == got[1]
    regions = recognizers.route_regions(spark.createDataFrame([("text",), ("odd",)], "type string")).collect()
    assert [r.engine for r in regions] == ["printed", None]
    first = df.withColumn("text", F.lit("ok")).withColumn("confidence", F.lit(0.7)).withColumn("tag", F.when(F.col("id") == 1, "RETRY_REQUIRED").otherwise("ACCEPTED"))
    fused = {r.id: (r.text, r.retried) for r in recognizers.retry_and_fuse(first, failing, "id", "t2").collect()}
    assert fused[1] == ("OK", True) and fused[2] == ("ok", False)


def test_spans():
    assert spans.math_regions("$y$ a $$x$$") == [(0, 3, "inline", "$y$"), (6, 5, "display", "$$x$$")]
    assert [e[2] for e in spans.grammar_errors("teh  end")] == ["Multiple spaces", "Common misspelling"]


def test_image_kernels():
    import numpy as np

    img = np.full((60, 40), 255, np.uint8)
    img[10:22, 5:35] = 0
    img[40:52, 5:35] = 0
    profile = images.projection(images.dark(img))
    assert images.count_lines(profile) == 2 and len(images.segments(profile)) == 2 and len(images.crop_lines(profile)) == 2
    assert len(images.baselines(profile)) == 2
    assert images.padded_square(img).shape == (60, 60) and images.normalized(img).shape == (60, 40, 3)


def test_decoding():
    import numpy as np

    steps = np.log(np.array([[0.1, 0.7, 0.2], [0.1, 0.2, 0.7], [0.9, 0.05, 0.05]]))
    assert decoding.beam_search(steps, 3, 0)[0][0] == [1, 2]
    lp = np.log(np.array([[0.6, 0.4], [0.6, 0.4]]))
    # outputs starting with symbol 1 over two steps: 1-, -1, 11 -> 1 - P(all blank)
    assert np.exp(decoding.ctc_prefix_score(lp, [1])) == pytest.approx(1 - 0.36)


def test_synthesized_line(spark):
    df = spark.createDataFrame([("l", 0, 10, 8), ("l", 1, 20, 12)], "line string, pos int, w int, h int")
    a, b = lines.synthesized_line(df, "line", "pos", "w", "h").orderBy("pos").collect()
    assert a.x == 0 and 30 <= b.x <= 60 and (a.y, b.y) == (2, 0) and a.canvas_width == b.x + 20


def test_summaries_rate_each_pair_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    pairs = spark.range(60).select(counted(F.concat(F.lit("x + "), F.col("id").cast("string"))).alias("prediction"), F.lit("x + 7").alias("reference"))
    got = metrics.math_summary(pairs).first()
    assert (got.n, got.tokens, got.edits, got.median_distance, seen.value) == (60, 180, 59, 1 / 3, 60)
    monkeypatch.setattr(catalogue, "pairs", lambda spark, sf_dir: pairs)
    got = catalogue.QUERIES["cer_summary"](spark, "").first()
    assert (got.n, seen.value) == (60, 120)
    got = metrics.corpus_summary(metrics.pairs_with_rates(pairs)).first()
    assert (got.n, got.median_wer, seen.value) == (60, 1 / 3, 180)


def test_distance_of_sequences_of_many_kinds(spark):
    """More distinct elements than there are private characters, null arrays, null elements, no elements."""
    a, b = F.transform(F.sequence(F.lit(1), F.lit(90000)), lambda i: i.cast("string")), F.transform(F.sequence(F.lit(2), F.lit(90001)), lambda i: i.cast("string"))
    rows = spark.range(1).select(F.explode(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(F.lit(None).alias("a"), b.alias("b")), F.struct(F.array().cast("array<string>").alias("a"), F.array(F.lit("x"), F.lit(None)).alias("b")), F.struct(F.array(F.lit(None).cast("string")).alias("a"), F.array(F.lit("x"), F.lit(None)).alias("b")))).alias("r"))
    assert [r[0] for r in rows.select(D.sequence_distance(F.col("r.a"), F.col("r.b"))).collect()] == [2, None, 2, 1]


SF = "/root/testdata/sf0.001"


def test_a_task_sorts_a_bounded_part_of_page_regions(spark, monkeypatch):
    """More rows make more tasks, not larger ones; the join with the pages hashes nothing; the rows stay the same."""
    few = sorted(map(tuple, catalogue.QUERIES["page_regions"](spark, SF).collect()))
    monkeypatch.setattr(catalogue, "TASK_ROWS", 500, raising=False)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500)
    assert catalogue.boxes(spark, SF).rdd.getNumPartitions() == n > 4
    many = catalogue.QUERIES["page_regions"](spark, SF)
    assert "HashAggregate" not in many._jdf.queryExecution().toString()
    assert sorted(map(tuple, many.collect())) == few


def test_reconstructed_pages_do_not_depend_on_the_number_of_tasks(spark, monkeypatch):
    few = sorted(map(tuple, catalogue.QUERIES["reconstruct_lines"](spark, SF).collect()))
    monkeypatch.setattr(catalogue, "TASK_ROWS", 500, raising=False)
    many = catalogue.QUERIES["reconstruct_lines"](spark, SF)
    assert many.rdd.getNumPartitions() > 4  # no later step gathers the rows in the session's few partitions
    assert sorted(map(tuple, many.collect())) == few
