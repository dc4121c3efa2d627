"""Spelling of recognized lines, and the chains of steps that end with it.

Unknown words meet the lexicon once for each distinct word, in length bands (`lexicon.similar`); the texts are put together again by their keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import lexicon

#: Corrections of a text by the full chain: all of them.
EVERY = 1 << 30


def correct_words(texts: DataFrame, words: DataFrame, key: str, domain: DataFrame | None = None, text: str = "text", distance: int = 2) -> DataFrame:
    """(key, corrected, corrections): every unknown word becomes the nearest known one, whole (marks at it go), with a capital if it had one.

    Words of under three letters, numbers, and words of the lexicon or the domain (tables with a column `word`) stay. Blank and null texts become empty ones."""
    known = lexicon.lexicon(words, domain) if domain is not None else lexicon.lexicon(words)
    parts = texts.select(key, F.posexplode(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).alias("pos", "whole"))
    parts = parts.withColumn("query", F.lower(F.regexp_replace("whole", r"(?U)[^\w]", "")))
    asked = parts.filter("length(query) >= 3").filter(~F.col("query").rlike(r"^\p{Nd}+$")).select("query").distinct()
    strange = asked.join(lexicon.small(known.select(F.col("word").alias("query"))), "query", "left_anti")
    best = lexicon.similar(strange, lexicon.lexicon(words), distance).filter("place = 1").select("query", F.col("word").alias("best"))
    met = parts.join(best, "query", "left")
    first = F.substring("whole", 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    said = F.when(F.col("best").isNull(), F.col("whole")).when(capital, F.concat(F.upper(F.substring("best", 1, 1)), F.col("best").substr(F.lit(2), F.length("best")))).otherwise(F.col("best"))
    rows = F.array_sort(F.collect_list(F.struct("pos", said.alias("said"))))
    done = met.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["said"]), " ").alias("corrected"), F.count("best").alias("corrections"))
    return texts.select(key).distinct().join(done, key, "left").select(key, F.coalesce("corrected", F.lit("")).alias("corrected"), F.coalesce("corrections", F.lit(0)).alias("corrections"))


def post_process(texts: DataFrame, key: str, words: DataFrame | None = None, domain: DataFrame | None = None, text: str = "text", math: bool = False, markup: bool = False) -> DataFrame:
    """(key, text, artifacts_removed, latex_cleaned, math_normalized, corrections): artifacts, markup, then spelling of prose (with a lexicon) or the form of formulas."""
    steps = texts.select(key, X.postprocess(F.coalesce(F.col(text), F.lit("")), math, markup).alias("p")).select(key, "p.*")
    if math or words is None:
        return steps.withColumn("corrections", F.lit(0).cast("bigint"))
    spelled = correct_words(steps, words, key, domain)
    return steps.drop("text").join(spelled, key).select(key, F.col("corrected").alias("text"), "artifacts_removed", "latex_cleaned", "math_normalized", "corrections")


def full_post_process(texts: DataFrame, words: DataFrame, key: str, text: str = "text", reject: bool = False, distance: int = 2) -> DataFrame:
    """(key, original, corrected, plausible, confidence): plausibility, then spelling (marks and case stay), then misspellings that recognizers make; with reject an implausible text becomes empty."""
    own = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("original"))
    spelled = lexicon.correct(own, words, key, "original", EVERY, distance)
    judged = own.withColumn("p", X.plausibility(F.col("original"))).join(spelled, key)
    fixed = X.fix_typos(F.col("corrected"))
    return judged.select(key, "original", (F.when(F.col("p.plausible"), fixed).otherwise("") if reject else fixed).alias("corrected"), "p.plausible", "p.confidence")


def symbol_chain(texts: DataFrame, key: str, text: str = "text", model: Callable[[DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """(key, corrected, asked): letters that stand for digits by rule; formulas of over five characters with a backslash then go to a language model, if there is one.

    model(rows, key, text) gives (key, reply); a row without a reply keeps what the rules made of it."""
    ruled = texts.select(key, X.symbol_rules(F.col(text)).alias("ruled"))
    asked = (F.length("ruled") > 5) & F.col("ruled").contains("\\")
    if model is None:
        return ruled.select(key, F.col("ruled").alias("corrected"), F.lit(False).alias("asked"))
    replies = model(ruled.filter(asked), key, "ruled")
    met = ruled.join(replies.select(key, "reply"), key, "left")
    return met.select(key, F.coalesce("reply", "ruled").alias("corrected"), F.coalesce(asked, F.lit(False)).alias("asked"))
