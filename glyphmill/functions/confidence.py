"""Confidence of recognized lines: mathematical consistency, composition, length, and what follows from the scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions import let
from glyphmill.functions.arithmetic import mean, total
from glyphmill.functions.distance import normalized, stripped

# Thresholds and patterns here, and the weights and tolerances in math_check, composite and length_score.
ACCEPT, RETRY = 0.85, 0.65
NUMBER = r"(?U)(-?\d+\.?\d*)"


def numbers(text: Column) -> Column:
    """All numbers of a text; a minus directly before one belongs to it."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 1), lambda x: x.cast("double"))


def _stated(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found.cast("double"))


def is_math(text: Column) -> Column:
    """At least two of: an operator, two numbers on a line, a keyword."""
    signals = [r"[+\-*/=]", r"(?U)\b\d+\b.*\b\d+\b", r"(?iU)\b(sum|mean|total|avg)\b"]
    return sum((text.rlike(s).cast("int") for s in signals), F.lit(0)) >= 2


def math_check(text: Column) -> Column:
    """struct(boost, is_math, validated, sum_check, mean_check): do the stated sums, means and quotients agree with the numbers of the line?"""
    division = r"(?U)(\d+\.?\d*)\s*/\s*(\d+\.?\d*)\s*=\s*(\d+\.?\d*)"
    facts = {
        "found": numbers(text),
        "keyword": text.rlike(r"[+\-*/=]") | text.rlike(r"(?iU)\b(sum|total|mean|average|avg|result|answer)\b"),
        # a chain of additions with its result at the end
        "result": F.when(text.contains("+"), _stated(text, r"(?U)=\s*(-?\d+\.?\d*)\s*$")),
        "addends": numbers(F.regexp_replace(text, r"=[^=]*\z", "")),
        "said": _stated(text, r"(?iU)(?:sum|total)\s*[=:]\s*(-?\d+\.?\d*)"),
        "middle": _stated(text, r"(?iU)(?:mean|average|avg)\s*[=:]\s*(-?\d+\.?\d*)"),
    } | {name: _stated(text, division, i) for i, name in enumerate("abc", 1)}
    return let(F.struct(*[c.alias(n) for n, c in facts.items()]), _check)


def _check(s: Column) -> Column:
    near = lambda a, b, least, share: F.abs(a - b) <= F.greatest(F.lit(least), F.abs(a) * share)
    looks = (F.size(s["found"]) >= 2) & s["keyword"]
    chain = F.when(s["result"].isNotNull() & (F.size(s["addends"]) > 0), near(total(s["addends"]), s["result"], 1.0, 0.05))
    rest, others = F.filter(s["found"], lambda x: x != s["said"]), F.filter(s["found"], lambda x: x != s["middle"])
    summed = F.when(s["said"].isNotNull() & (F.size(rest) > 0), near(total(rest), s["said"], 1.0, 0.05))
    averaged = F.when(s["middle"].isNotNull() & (F.size(others) > 0), near(mean(others), s["middle"], 0.5, 0.05))
    divided = F.coalesce(F.when(s["b"] != 0, near(s["a"] / s["b"], s["c"], 0.01, 0.02)), F.lit(False))
    worth = lambda check, plus: F.when(check, plus).when(~check, -0.05).otherwise(0.0)
    boost = worth(chain, 0.12) + worth(summed, 0.10) + worth(averaged, 0.10) + F.when(divided, 0.12).otherwise(0.0)
    boost = F.when(looks, boost).otherwise(0.0)
    told = lambda check: F.when(looks & check, "PASS").when(looks & ~check, "FAIL")
    return F.struct(F.greatest(F.lit(-0.15), F.least(F.lit(0.15), boost)).alias("boost"), looks.alias("is_math"), (boost > 0).alias("validated"), F.coalesce(told(summed), told(chain)).alias("sum_check"), told(averaged).alias("mean_check"))


def alpha_ratio(text: Column) -> Column:
    """Share of letters, digits, white space and common marks; 0 for an empty text."""
    kept = F.length(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}\s.,;:!?\-+=/()\[\]{}$\\]", ""))
    return F.when(F.length(text) == 0, 0.0).otherwise(kept / F.length(text))


def length_score(text: Column, least: int = 2, most: int = 500) -> Column:
    n = F.length(stripped(text))
    return F.when(n < least, F.greatest(F.lit(0.1), n / least * 0.4)).when(n <= most, 1.0).otherwise(0.4)


def classify(score: Column, accept: float = ACCEPT, retry: float = RETRY) -> Column:
    return F.when(score >= accept, "ACCEPTED").when(score >= retry, "RETRY_REQUIRED").otherwise("FAILED_EXTRACTION")


def composite(text: Column, token_confidence: Column, check: Column) -> Column:
    """0.45 token + 0.25 composition + 0.15 length + 0.15 mathematics, plus the check's boost, within [0, 1], to four places."""
    base = F.when(check["validated"], 1.0).when(check["is_math"], 0.3).otherwise(0.5)
    score = 0.45 * token_confidence + 0.25 * alpha_ratio(text) + 0.15 * length_score(text) + 0.15 * base + check["boost"]
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def should_retry(tag: Column) -> Column:
    return tag == "RETRY_REQUIRED"


def first_is_best(score_a: Column, valid_a: Column, score_b: Column, valid_b: Column) -> Column:
    """A validated result gets 0.05 more; of equals the first."""
    return score_a + F.when(valid_a, 0.05).otherwise(0.0) >= score_b + F.when(valid_b, 0.05).otherwise(0.0)


def fuse(text_a: Column, score_a: Column, valid_a: Column, text_b: Column, score_b: Column, valid_b: Column) -> Column:
    """struct(text, composite, tag, agreed): equal texts strengthen each other, else a validated one wins, else the better one."""
    agreed = normalized(text_a) == normalized(text_b)
    best = first_is_best(score_a, valid_a, score_b, valid_b)
    first = F.when(agreed, best).when(valid_a & ~valid_b, True).when(valid_b & ~valid_a, False).otherwise(best)
    score = F.when(first, score_a).otherwise(score_b)
    score = F.when(agreed, F.least(F.lit(1.0), score + 0.10)).otherwise(score)
    return F.struct(F.when(first, text_a).otherwise(text_b).alias("text"), score.alias("composite"), classify(score).alias("tag"), agreed.alias("agreed"))


def shifted(v: Column) -> Column:
    """Less the largest value, as doubles."""
    return let(F.struct(v.alias("v"), F.array_max(v).alias("top")), lambda s: F.transform(s["v"], lambda x: (x - s["top"]).cast("double")))


def _exp_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda t, x: t + F.exp(x))


def softmax(v: Column) -> Column:
    return let(shifted(v), lambda d: let(F.struct(d.alias("d"), _exp_sum(d).alias("whole")), lambda s: F.transform(s["d"], lambda x: F.exp(x) / s["whole"])))


def log_softmax(v: Column) -> Column:
    return let(shifted(v), lambda d: let(F.struct(d.alias("d"), F.log(_exp_sum(d)).alias("whole")), lambda s: F.transform(s["d"], lambda x: x - s["whole"])))


def token_confidence(steps: Column) -> Column:
    """Mean over the steps (arrays of logits) of the largest softmax value; 0.5 without steps."""
    return F.coalesce(mean(F.transform(steps, lambda v: 1.0 / _exp_sum(shifted(v)))), F.lit(0.5))


def geometric_confidence(probabilities: Column) -> Column:
    """exp of the mean log probability; 1 without any."""
    return F.exp(F.coalesce(mean(F.transform(probabilities, lambda p: F.log(p + 1e-10))), F.lit(0.0)))


def sequence_confidence(p: Column) -> Column:
    """0.4 mean + 0.3 smallest + 0.3 / (1 + entropy) of the steps' probabilities."""
    entropy = -mean(F.transform(p, lambda x: x * F.log(x + 1e-10)))
    return 0.4 * mean(p) + 0.3 * F.array_min(p) + 0.3 / (1.0 + entropy)


def agreement(texts: Column) -> Column:
    """1 / number of different texts among the first three."""
    return 1.0 / F.size(F.array_distinct(F.slice(texts, 1, 3)))


def greedy(steps: Column, end: int) -> Column:
    """Index of the largest logit of each step, up to the end symbol."""
    best = F.transform(steps, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))
    at = F.array_position(best, F.lit(end)).cast("int")
    return F.when(at > 0, F.slice(best, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(best)


def rejection(confidence: Column, text: Column) -> Column:
    """Why an output is rejected, else null."""
    kinds = F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))
    return F.when(confidence < 0.5, "confidence_below_threshold").when(stripped(text) == "", "empty_output").when((kinds < 3) & (F.length(text) > 5), "low_character_diversity")
