import json

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import arithmetic as A
from glyphmill.functions import distance as D
from glyphmill.operators.arithmetic import arithmetic_results, as_json


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize("a,b,d", [("30", "30", 0), ("30", "20", 1), ("3", "30", 1), ("abc", "xyz", 3), ("", "", 0), ("abc", "", 3)])
def test_levenshtein(spark, a, b, d):
    assert one(spark, F.levenshtein(lit(a), lit(b))) == d


def test_similarity(spark):
    got = [one(spark, D.similarity(lit(a), lit(b))) for a, b in (("30", "30"), ("abc", "xyz"), ("", ""), ("abc", ""), ("30", "20"))]
    assert got[:4] == [1, 0, 1, 0] and 0 < got[4] < 1


@pytest.mark.parametrize("raw", [r"\frac{25}{5}", r"25 \times 5", "$25 + 30$", r"\sqrt{x} {a}"])
def test_clean_leaves_no_markup(spark, raw):
    assert not set(one(spark, A.clean(lit(raw)))) & set("\\{}$")


def test_clean_reads_lookalikes(spark):
    assert "30" in one(spark, A.clean(lit("3O"))) and "15" in one(spark, A.clean(lit("l5")))


def test_tokens(spark):
    assert one(spark, A.tokens(lit("25 + 30 + 28"))) == ["25", "+", "30", "+", "28"]
    assert one(spark, A.tokens(lit(""))) == []


def test_markup_found(spark):
    got = [one(spark, F.size(A.markup_found(lit(t)))) for t in (r"\frac{25}{5}", "25 + {30}", "25 + 30 + 28")]
    assert got[0] > 0 and got[1] > 0 and got[2] == 0


def test_banned_keeps_repeated_names(spark):
    assert one(spark, A.banned(lit(r"\begin{a}\end{a}"))) == ["LaTeX environment", "LaTeX environment", "Curly brace (LaTeX)", "Curly brace (LaTeX)"]


def test_correct_token(spark):
    c = one(spark, A.correct_token(lit("30")))
    assert (c.corrected, c.confidence) == ("30", 1)
    assert 0 <= int(one(spark, A.correct_token(lit("150"))).corrected) <= 100
    assert one(spark, A.correct_token(lit("@#@#"))).token_type == "discarded"
    assert one(spark, A.correct_token(lit("×"))).corrected == "+"


def test_reasons(spark):
    tokens = lambda *t: F.transform(F.array(*[lit(x) for x in t]), lambda t: A.correct_token(t))
    assert one(spark, A.reasons(tokens("25", "+", "30"))) == []
    assert any("need at least" in r for r in one(spark, A.reasons(tokens("25"))))
    wide = A.Config(high=200)
    out = one(spark, A.reasons(F.transform(F.array(lit("150"), lit("20")), lambda t: A.correct_token(t, wide))))
    assert any("outside range" in r for r in out)


def test_expression_and_mean(spark):
    ints = lambda *v: F.array(*[lit(x) for x in v]) if v else F.array().cast("array<int>")
    assert one(spark, A.expression(ints(42))) == "42" and one(spark, A.expression(ints())) == ""
    assert "/ 7" in one(spark, A.expression(ints(*range(7))))
    assert one(spark, A.mean(ints(20, 40))) == 30 and one(spark, A.mean(ints())) is None


GOLDEN = [
    ("25 + 30 + 28 + 35 + 32", "25 + 30 + 28 + 35 + 32", [25, 30, 28, 35, 32], 30.0, "success", 0.9918),
    ("25 + 30", "25 + 30", [25, 30], 27.5, "success", 0.949),
    ("42", "42", [42], None, "retry", 0.0),
    ("", "", [], None, "retry", 0.0),
    (None, "", [], None, "retry", 0.0),
    (r"\frac{25 + 30}{2}", "", [], None, "retry", 0.0),
    ("abc 25 def + 30 ghi + 28", "6 25  + 30 91 + 28", [6, 25, 30, 91, 28], 36.0, "success", 0.9309),
    ("3O + l5", "30 + 15", [30, 15], 22.5, "success", 0.937),
    ("25 + 30 / 2 = 27.5", "25 + 30 / 2 = 27.5", [25, 30, 2, 27], 21.0, "success", 0.9733),
    ("150 + 20", "150 + 20", [10, 20], 15.0, "success", 0.9097),
    ("0 + 100", "0 + 100", [0, 100], 50.0, "success", 0.835),
    ("25 + 30 + 28 + 35 + 32 + 30 + 29", "25 + 30 + 28 + 35 + 32 + 30 + 29", [25, 30, 28, 35, 32, 30, 29], 29.8571, "success", 0.993),
]


def test_pipeline_goldens(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "id int, raw string")
    rows = {r.id: r for r in as_json(arithmetic_results(df)).collect()}
    for i, (raw, cleaned, numbers, result, status, confidence) in enumerate(GOLDEN):
        r = rows[i]
        assert (r.cleaned, r.numbers, r.result, r.status, r.confidence) == (cleaned, numbers, result, status, confidence), raw
        said = json.loads(r.json)
        assert {"status", "numbers", "expression", "confidence"} <= set(said) and ("reason" in said) == (status == "retry")


def test_pipeline_plan_has_no_shuffle(spark):
    df = spark.createDataFrame([("1 + 2",)], "raw string")
    assert "Exchange" not in arithmetic_results(df)._jdf.queryExecution().executedPlan().toString()
