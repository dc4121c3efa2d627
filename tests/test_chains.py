"""Spelling chains, recognizer slots that fail or hang, document pages, decoding with outside scores."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import decoding, layout, metrics, recognizers, spans, spelling
from glyphmill.sources import readers, writers


def words(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "word string")


def test_spelling_chains(spark):
    texts = spark.createDataFrame([(1, "Teh houze, 12 qq integrall"), (2, None), (3, "  "), (4, "House")], "id long, text string")
    lexicon = words(spark, "the", "house", "integral")
    got = {r.id: (r.corrected, r.corrections) for r in spelling.correct_words(texts, lexicon, "id", words(spark, "integrall")).collect()}
    assert got == {1: ("The house 12 qq integrall", 2), 2: ("", 0), 3: ("", 0), 4: ("House", 0)}  # marks at a replaced word go
    done = {r.id: r for r in spelling.post_process(texts, "id", lexicon).collect()}
    assert done[1].text == "The house 12 qq integral" and done[1].corrections == 3 and done[2].text == ""
    full = {r.id: r for r in spelling.full_post_process(texts, lexicon, "id", reject=True).collect()}
    assert full[1].corrected == "The house, 12 qq integral" and full[1].plausible and full[2].corrected == "" and not full[2].plausible


def test_symbol_chain_keeps_what_the_model_does_not_answer(spark):
    texts = spark.createDataFrame([(1, r"\frac{Z}{4}"), (2, "Z"), (3, r"\alpha + l")], "id long, text string")
    model = lambda rows, key, text: rows.filter("id = 1").select(key, F.upper(text).alias("reply"))
    got = {r.id: (r.corrected, r.asked) for r in spelling.symbol_chain(texts, "id", model=model).collect()}
    assert got == {1: (r"\FRAC{2}{4}", True), 2: ("2", False), 3: (r"\alpha + 1", True)}


def picky():
    """A factory that workers get by value."""

    def made():
        def engine(items):
            if any(b == b"bad" for b in items):
                raise RuntimeError("no")
            if b"slow" in items:
                time.sleep(5)
            return [(b.decode(), 0.8) for b in items]

        return engine

    return made


def test_recognizers_fail_item_by_item(spark):
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate((b"a", b"bad", b"slow", b"c"))], "id long, data binary").coalesce(1)
    began = time.time()
    got = {r.id: (r.text, r.error) for r in recognizers.recognize(rows, picky(), "id", name="picky", seconds=0.5, tries=2).collect()}
    assert got[0] == ("a", None) and got[3] == ("c", None) and got[1] == ("", "RuntimeError: no") and got[2][1].startswith("TimeoutError") and time.time() - began < 60
    regions = spark.createDataFrame([(1, 7, "text_line", bytearray(b"x")), (2, 7, "figure", bytearray(b"y")), (3, 7, "text_line", bytearray(b"bad"))], "region_id long, page_id long, class_name string, data binary")
    (record,) = recognizers.pseudo_labels(regions, picky(), name="picky2").collect()
    assert (record.image_path, record.ground_truth_text, record.pseudo_labeled, record.source_page) == ("7/1.png", "x", True, "7")


def renderer():
    def made():
        def pages(content):
            if not content.startswith(b"%PDF"):
                raise ValueError("no document")
            return [(p, p.decode()) for p in content[4:].split(b"|")]

        return pages

    return made


def test_document_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDFone||three|four")
    (tmp_path / "b.pdf").write_bytes(b"junk")
    rows = sorted(readers.document_pages(spark, str(tmp_path), renderer(), most=3).collect(), key=lambda r: (r.path, r.page))
    assert [(r.page, r.text, r.mode) for r in rows[:3]] == [(1, "one", "pdf_page"), (2, "", "needs_labeling"), (3, "three", "pdf_page")]
    assert len(rows) == 4 and rows[3].error == "ValueError: no document"


def test_loaders_reports_and_crops(spark, tmp_path):
    class Own(readers.Loader):
        name = "own"

        def load(self, spark):
            return spark.createDataFrame([("a.png", "t", "text", 1)], "image_path string, ground_truth_text string, mode string, more int")

    assert Own().manifest(spark).first().asDict() == {"image_path": "a.png", "ground_truth_text": "t", "mode": "text", "partition": "own"}
    with pytest.raises(NotImplementedError):
        readers.Loader().manifest(spark)
    status = spark.createDataFrame([("b", None), ("a", "/x")], "name string, path string")
    writers.report(status, str(tmp_path / "r"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "r/markdown"), wholetext=True).collect()).strip() == "# Status\n\n- **a**: /x\n- **b**: missing"
    writers.crops(spark.createDataFrame([("c", bytearray(b"\x01"))], "name string, data binary"), str(tmp_path / "c"))
    assert bytes(spark.read.parquet(str(tmp_path / "c")).first().data) == b"\x01"


def test_pages_without_regions_and_suggestions(spark):
    regions = spark.createDataFrame([(1, "text", 0, 0, 5, 5, 1, 0.5)], "page_id long, label string, x1 int, y1 int, x2 int, y2 int, pos int, confidence double")
    pages = spark.createDataFrame([(1, 10, 20), (2, 30, 40)], "page_id long, width int, height int")
    got = {r.page_id: (r.x2, r.y2) for r in layout.with_page_fallback(regions, pages).collect()}
    assert got == {1: (5, 5), 2: (30, 40)}
    found = spark.createDataFrame([(1, 0, 3, "k", "teh")], "id long, offset int, length int, kind string, context string")
    known = spark.createDataFrame([("teh", i, s) for i, s in enumerate("abcd")], "context string, place int, suggestion string")
    assert spans.suggested(found, known, "id").first().suggestions == ["a", "b", "c"]


def test_checkpoints_and_medians(spark):
    rows = spark.createDataFrame([("a", "x y", "x y"), ("a", None, "z"), ("b", None, "q")], "checkpoint string, prediction string, reference string")
    got = {r.checkpoint: (r.mean_cer, r.mean_wer, r.num_evaluated) for r in metrics.checkpoint_means(rows).collect()}
    assert got == {"a": (0.0, 0.0, 1), "b": (None, None, 0)}
    rng = np.random.default_rng(1)
    values = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 500), np.round(rng.exponential(1, 500), 2), strict=True)] + [(3, 1.0)] * 4 + [(4, None)]
    table = spark.createDataFrame(values, "k long, v double")
    want = {k: sorted(v for x, v in values if x == k and v is not None) for k in range(4)}
    for ranges in (1, 7, 1024):
        assert {r.k: r.median for r in metrics.upper_median(table, ["k"], "v", ranges).collect()} == {k: v[len(v) // 2] for k, v in want.items()}
    assert metrics.upper_median(table, [], "v").first().median == sorted(v for _, v in values if v is not None)[502 // 2 + 1]


def test_decoding_with_frames_and_outside_scores(spark):
    logits = [[-9.0, 2.0, 1.0], [-9.0, 1.0, 2.0]]
    frames = [[0.0, 0.0, 9.0], [9.0, 0.0, 0.0], [0.0, 9.0, 0.0]]
    rows = spark.createDataFrame([(1, logits, frames)], "id long, logits array<array<double>>, frames array<array<double>>")
    plain = decoding.decode(rows, "id").first()
    mixed = decoding.decode(rows, "id", ctc="frames", weight=0.9).first()
    told = decoding.decode(rows, "id", score_of=lambda s: 50.0 * (s == [2, 2])).first()
    assert plain.sequence == [1, 2] and mixed.sequence[0] == 2 and told.sequence == [2, 2]
