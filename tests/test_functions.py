import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import confidence as C
from glyphmill.functions import distance as D
from glyphmill.functions import geometry as G
from glyphmill.functions import routing as R
from glyphmill.functions import text as X


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize("p,r,cer,wer,wer2", [("kitten", "sitting", 0.4286, 1, 1), ("We obtain", "We obtain", 0, 0, 0), ("Suppose tat", "Suppose that", 0.0833, 0.5, 0.5), ("", "abc", 1, 1, 1), ("abc", "", 1, 1, 1), ("", "", 0, 0, 0), (" ", "", 1, 1, 0), ("", " ", 1, 0, 0)])
def test_error_rates(spark, p, r, cer, wer, wer2):
    assert round(one(spark, D.cer(lit(p), lit(r))), 4) == cer
    assert one(spark, D.wer(lit(p), lit(r))) == wer and one(spark, D.wer_stripped(lit(p), lit(r))) == wer2


@pytest.mark.parametrize("s,tokens", [(r"$\frac{dy}{dx} = 2x$", r"\frac { d y } { d x } = 2 x"), ("$E = mc^2$", "E = m c ^ 2"), (r"\sum_{n=1}^{\infty} 3.14\,x", r"\sum _ { n = 1 } ^ { \infty } 3.14 \, x")])
def test_latex_tokens(spark, s, tokens):
    assert " ".join(one(spark, D.latex_tokens(lit(s)))) == tokens


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from("a bb ccc é 漢".split()), max_size=8), st.lists(st.sampled_from("a bb d é".split()), max_size=8))
def test_sequence_distance(spark, a, b):
    array = lambda v: F.array(*[lit(x) for x in v]).cast("array<string>")
    got = one(spark, D.sequence_distance(array(a), array(b)))
    assert got == edits(a, b) == one(spark, D.sequence_distance(array(b), array(a)))


GATE = [("Consider the function", 0.5, 0.7, "RETRY_REQUIRED"), ("Consider the function", 0.95, 0.9025, "ACCEPTED"), ("25 + 30 + 28 = 83", 0.5, 0.895, "ACCEPTED"), ("25 + 30 + 28 = 209", 0.5, 0.62, "FAILED_EXTRACTION"), ("209 / 7 = 29.857", 0.5, 0.895, "ACCEPTED"), ("10 20 30 sum = 60", 0.5, 0.875, "ACCEPTED"), ("10 20 30 mean: 20", 0.5, 0.875, "ACCEPTED"), ("", 0.5, 0.315, "FAILED_EXTRACTION"), ("@@##%%", 0.5, 0.45, "FAILED_EXTRACTION"), ("x", 0.5, 0.58, "FAILED_EXTRACTION")]


def test_confidence_gate(spark):
    df = spark.createDataFrame([(i, t, c) for i, (t, c, _, _) in enumerate(GATE)], "id int, text string, token double").withColumn("check", C.math_check(F.col("text")))
    df = df.withColumn("score", C.composite(F.col("text"), F.col("token"), F.col("check"))).withColumn("tag", C.classify(F.col("score")))
    for r in df.collect():
        assert (round(r.score, 4), r.tag) == GATE[r.id][2:], r.text


def test_classify_borders(spark):
    assert [one(spark, C.classify(lit(x))) for x in (0.85, 0.8499, 0.65, 0.6499)] == ["ACCEPTED", "RETRY_REQUIRED", "RETRY_REQUIRED", "FAILED_EXTRACTION"]


def test_fusion(spark):
    f = one(spark, C.fuse(lit("A  b"), lit(0.70), lit(False), lit("a B"), lit(0.72), lit(False)))
    assert (f.text, round(f.composite, 2), f.tag, f.agreed) == ("a B", 0.82, "RETRY_REQUIRED", True)


def test_numbers(spark):
    assert one(spark, C.numbers(lit("30-28"))) == [30, -28]


def test_softmax_and_confidences(spark):
    v = F.array(lit(1.0), lit(2.0), lit(3.0))
    assert math.isclose(sum(one(spark, C.softmax(v))), 1) and math.isclose(one(spark, C.log_softmax(v))[2], math.log(one(spark, C.softmax(v))[2]))
    assert math.isclose(one(spark, C.token_confidence(F.array(v))), one(spark, C.softmax(v))[2])
    assert one(spark, C.token_confidence(F.array().cast("array<array<double>>"))) == 0.5
    assert one(spark, C.geometric_confidence(F.array().cast("array<double>"))) == 1
    assert one(spark, C.greedy(F.array(v, F.array(lit(9.0), lit(0.0), lit(0.0)), v), 0)) == [2]


@pytest.mark.parametrize("f,a,b", [
    (X.remove_artifacts, "# Hello   world...!! #", "Hello world!"),
    (X.normalize_math, "2×(3+4", "2*(3 + 4)"),
    (X.balance_braces, "a}b{c", "ab{c}"),
    (X.postprocess_latex, "a}b}", "{{a}b}"),
    (X.symbol_rules, "x =  Z ", "x =  2 "),
    (X.symbol_rules, "x =  l ", "x =  1 "),
    (X.symbol_rules, "A B  O  C", "A B  0  C"),
    (X.cleanup_latex, r"\frac  {a} { b }", r"\frac{a} {b}"),
    (X.fix_typos, "teh  cat adn form the dog", "the cat and from the dog"),
    (X.strip_markup, r"a \frac{1}{2} \alpha {b}", "a b"),
    (X.strip_fences, "```json\n[1]\n```", "[1]"),
    (X.problem_class, "This is Algebra.", "algebra"),
    (X.label_of, "$x$", "x"),
])
def test_rewriting(spark, f, a, b):
    assert one(spark, f(lit(a))) == b


@pytest.mark.parametrize("s,ok", [(r"\frac{1}{2}", True), (r"\frac{1}{2", False), (r"\begin{pmatrix} a \end{pmatrix}", True), (r"\begin{pmatrix} a", False), ("x^2+1=0", True), ("x^{2", False), ("}{", False), (" ", False)])
def test_valid_latex(spark, s, ok):
    assert one(spark, X.valid_latex(lit(s))) is ok


def test_judging(spark):
    assert one(spark, X.has_repetition(lit("a b b b c"))) and one(spark, X.has_repetition(lit("xaaaaa"))) and not one(spark, X.has_repetition(lit("a b b c")))
    assert [one(spark, X.plausibility(lit(t)))["reason"] for t in ("", "1234", "the the the cat", "a fine line")] == ["empty_text", "low_alpha_ratio", "excessive_repetition", "passed"]
    assert one(spark, X.solution_steps(lit(" a \n\n b"))) == ["a", "b"]
    assert one(spark, X.image_bytes(lit("data:image/png;base64,aGk="))) == b"hi" and one(spark, X.image_bytes(lit("data:,*"))) is None


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab{} #.", max_size=20))
def test_cleaning_is_idempotent(spark, s):
    for f in (X.balance_braces, X.remove_artifacts):
        once = one(spark, f(lit(s)))
        assert one(spark, f(lit(once))) == once


def test_geometry(spark):
    b = G.box(lit(10), lit(20), lit(30), lit(60))
    assert one(spark, G.clamp(b, lit(32), lit(100)))["x2"] == 32
    assert one(spark, G.clamp(G.box(lit(50), lit(0), lit(60), lit(9)), lit(32), lit(100))) is None
    assert math.isclose(one(spark, G.iou(b, G.box(lit(10), lit(20), lit(30), lit(40)))), 0.5)
    assert one(spark, G.detector_label(lit(1), b, 100, 100)) == "1 0.200000 0.400000 0.200000 0.400000"
    assert one(spark, G.stride_padded(lit(33))) == 64
    assert one(spark, G.from_corner_size(F.array(lit(1.0), lit(2.0), lit(3.0), lit(4.0))))["y2"] == 6
    assert one(spark, G.resolution_scale(lit(50))) == 300 / 72 and one(spark, G.resolution_scale(lit(500))) == 1


def test_routing(spark):
    every = F.array(lit("mathpix"), lit("arithmetic"), lit("trocr"))
    assert one(spark, R.decide(lit(0.5), lit(True), lit(False), every))["engine"] == "mathpix"
    assert one(spark, R.decide(lit(0.5), lit(True), lit(True), every))["engine"] == "none"
    assert one(spark, R.smart_route(lit(0.2), lit(False), every)) == "both"
    assert one(spark, R.profile(lit(79.0), lit(50.0))) == "degraded"
    assert one(spark, R.reroute(lit("t"), lit(0.3), lit("f"), lit(0.8), lit(False), lit(False)))["text"] == "f"


def test_postprocess_and_checked(spark):
    got = one(spark, X.postprocess(lit(r"# a \frac{1}{2} b #"), markup=True))
    assert (got.text, got.artifacts_removed, got.latex_cleaned) == ("a b", True, True)
    assert one(spark, X.postprocess(lit("1+2"), math=True)).text == "1 + 2"
    assert one(spark, X.checked(lit("teh cat")))["corrected"] == "the cat" and one(spark, X.checked(lit("12"), reject=True))["corrected"] == ""


def test_scaled_traces(spark):
    point = lambda x, y: F.struct(lit(x).alias("x"), lit(y).alias("y"))
    got = one(spark, G.scaled_traces(F.array(F.array(point(1.0, 2.0), point(3.0, 10.0))), target=120, margin=20))
    assert [(p.x, p.y) for p in got.traces[0]] == [(20, 20), (40, 100)] and got.width == 60
