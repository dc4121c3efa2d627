"""Which recognizer reads what: rules over image features and first results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The limits of the rules.
BLUR, CONTRAST, MATH, SOME_MATH = 80.0, 40.0, 0.3, 0.15
BADGES = {"ACCEPTED": "accepted", "RETRY_REQUIRED": "retry", "FAILED_EXTRACTION": "failed"}


def profile(blur: Column, contrast: Column) -> Column:
    return F.when((blur < BLUR) | (contrast < CONTRAST), "degraded").otherwise("clean")


def is_blank(contrast: Column, text_density: Column) -> Column:
    return (contrast < 10) | (text_density < 0.005)


def is_arithmetic(lines: Column, text_density: Column) -> Column:
    return (lines <= 5) & (text_density < 0.15)


def decide(math_density: Column, arithmetic: Column, blank: Column, available: Column) -> Column:
    """struct(engine, confidence): nothing for blank pages, then formulas, arithmetic, and the default."""
    said = lambda engine, confidence: F.struct(F.lit(engine).alias("engine"), F.lit(confidence).alias("confidence"))
    has = lambda name: F.array_contains(available, name)
    return F.when(blank, said("none", 0.0)).when((math_density > MATH) & has("mathpix"), said("mathpix", 0.8)).when(arithmetic & has("arithmetic"), said("arithmetic", 0.7)).when(has("trocr"), said("trocr", 0.6)).otherwise(said("trocr", 0.5))


def smart_route(math_density: Column, arithmetic: Column, available: Column) -> Column:
    has = lambda name: F.array_contains(available, name)
    return F.when(arithmetic & has("arithmetic"), "arithmetic").when((math_density > MATH) & has("mathpix"), "mathpix").when((math_density > SOME_MATH) & has("mathpix"), "both").otherwise("trocr")


def fallback(engine: Column, available: Column) -> Column:
    """The other engine of a pair, if there; else the same again."""
    other = F.when(engine == "mathpix", "trocr").otherwise("mathpix")
    return F.when(F.array_contains(available, other), other).otherwise(engine)


def reroute(text: Column, text_confidence: Column, formula: Column, formula_confidence: Column, formula_discarded: Column, is_formula: Column, least: float = 0.4) -> Column:
    """struct(text, confidence, rerouted): an unsure text gives way to a better formula, a discarded formula to a better text."""
    swap = F.when(is_formula, formula_discarded & (text_confidence > formula_confidence)).otherwise((text_confidence < least) & (formula_confidence > text_confidence) & ~formula_discarded)
    use_formula = is_formula != swap
    return F.struct(F.when(use_formula, formula).otherwise(text).alias("text"), F.when(use_formula, formula_confidence).otherwise(text_confidence).alias("confidence"), swap.alias("rerouted"))


def badge(tag: Column) -> Column:
    out = F.lit("unknown")
    for name, label in BADGES.items():
        out = F.when(tag == name, label).otherwise(out)
    return out
