"""The arithmetic pipeline over a table of raw texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import arithmetic as A


def arithmetic_results(df: DataFrame, raw: str = "raw", config: A.Config = A.DEFAULT) -> DataFrame:
    """df with cleaned, tokens, corrected, numbers, expression, result, confidence, status, reason and issues: one projection after another, no shuffle.

    The last self-check recomputes everything from the numbers in range, so its reasons are the final ones; the check before it only adds issues."""
    df = df.withColumn("cleaned", A.clean(F.col(raw))).withColumn("tokens", A.tokens(F.col("cleaned")))
    df = df.withColumn("corrected", A.correct_all(F.col("tokens"), config))
    df = df.withColumn("numbers", F.filter(A.numbers_of(F.col("corrected")), lambda n: n.between(config.low, config.high)))
    enough = F.size("numbers") >= config.least_numbers
    score = A.confidence(F.col("corrected"), F.col("numbers"), F.size(A.reasons(F.col("corrected"), config)), config)
    df = df.withColumn("confidence", F.when(enough, score).otherwise(0.0))
    low = F.col("confidence") < config.threshold
    return (
        df.withColumn("expression", F.when(enough, A.expression(F.col("numbers"))).otherwise(""))
        .withColumn("result", F.when(enough, F.round(A.mean(F.col("numbers")), 4)))
        .withColumn("status", F.when(enough & ~low, "success").otherwise("retry"))
        .withColumn("reason", F.when(~enough, "Insufficient valid numbers after correction").when(low, "low confidence after correction").otherwise(""))
        .withColumn("issues", A.banned(F.col(raw)))
    )


def as_json(results: DataFrame) -> DataFrame:
    """results with `json`: status, numbers, expression, result, confidence, and the reason if there is one."""
    reason = F.when(F.col("reason") != "", F.col("reason")).alias("reason")
    return results.withColumn("json", F.to_json(F.struct("status", "numbers", "expression", "result", "confidence", reason)))
