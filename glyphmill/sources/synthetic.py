"""Reproducible synthetic samples from ranges and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = ("We obtain the result", "Suppose that", "Therefore", "by induction", "Consider the function")
FORMULAS = (r"E = mc^2", r"\frac{dy}{dx} = 2x", r"\sum_{n=1}^{\infty} \frac{1}{n^2}", r"\int_0^1 x^2 dx", r"a^2 + b^2 = c^2")


def draw(seed: int, *parts) -> Column:
    """A share of [0, 1) from the row number."""
    return F.pmod(F.xxhash64("id", F.lit(seed), *[F.lit(p) for p in parts]), F.lit(1_000_003)) / 1_000_003


def pick(values: tuple[str, ...], share: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(share * len(values)) + 1).cast("int"))


def samples(spark: SparkSession, n: int, seed: int = 42, shares: tuple[float, float] = (0.4, 0.4)) -> DataFrame:
    """Manifest rows: texts, formulas in dollar signs, and both, by shares."""
    kind = draw(seed, "mode")
    mode = F.when(kind < shares[0], "text").when(kind < shares[0] + shares[1], "math").otherwise("mixed")
    text, formula = pick(TEXTS, draw(seed, "text")), F.concat(F.lit("$"), pick(FORMULAS, draw(seed, "math")), F.lit("$"))
    said = F.when(mode == "text", text).when(mode == "math", formula).otherwise(F.concat(text, F.lit(" "), formula))
    return spark.range(n).select(F.format_string("data/synthetic/%s_%06d.png", mode, F.col("id")).alias("image_path"), said.alias("ground_truth_text"), mode.alias("mode"))


def formulas(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(id, latex): polynomials, integrals and matrices with small coefficients."""
    number = lambda name, low, high: (F.floor(draw(seed, name) * (high - low + 1)) + low).cast("int")
    a, b, c, d = (number(x, 1, 9) for x in "abcd")
    kind = F.floor(draw(seed, "kind") * 3)
    polynomial = F.format_string("%dx^2 + %dx + %d", a, b, c)
    integral = F.format_string("\\int_{%d}^{%d} %dx^%d \\, dx", a, a + b, c, d)
    matrix = F.format_string("\\begin{pmatrix} %d & %d \\\\ %d & %d \\end{pmatrix}", a, b, c, d)
    return spark.range(n).select("id", F.when(kind == 0, polynomial).when(kind == 1, integral).otherwise(matrix).alias("latex"))


def layout_labels(spark: SparkSession, n: int, size: int = 640, classes: int = 4, boxes: int = 5, seed: int = 42) -> DataFrame:
    """(page_id, label): detector label lines of random boxes inside a square page."""
    rows = spark.range(n).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(boxes - 1))))
    share = lambda name: F.pmod(F.xxhash64("id", "k", F.lit(seed), F.lit(name)), F.lit(1_000_003)) / 1_000_003
    w, h = 0.1 + 0.4 * share("w"), 0.05 + 0.2 * share("h")
    cx, cy = w / 2 + (1 - w) * share("x"), h / 2 + (1 - h) * share("y")
    return rows.select(F.col("id").alias("page_id"), F.format_string("%d %.6f %.6f %.6f %.6f", F.floor(share("c") * classes), cx, cy, w, h).alias("label"))
