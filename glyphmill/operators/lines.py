"""Ordered lines of text: broken lines, words in order, log times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.functions.distance import stripped


def merge_broken(df: DataFrame, group: str, pos: str, text: str = "text") -> DataFrame:
    """(group, island, text): a line that does not end a sentence goes on in the next one. Blank lines are skipped.

    What ends the text so far is always its last line, so looking one line back is exact."""
    rows = df.select(group, pos, stripped(F.coalesce(F.col(text), F.lit(""))).alias("text")).filter("text <> ''")
    order = W.partitionBy(group).orderBy(pos)
    ended = F.coalesce(F.lag("text").over(order).rlike(r"[.!?:;]$"), F.lit(False))
    rows = rows.withColumn("ended", ended.cast("int")).withColumn("island", F.sum("ended").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "text"))), lambda r: r["text"]), " ")
    return rows.groupBy(group, "island").agg(joined.alias("text"))


def process_lines(df: DataFrame, group: str, pos: str, text: str = "text", math: bool = False) -> DataFrame:
    """(group, n_lines, artifacts, merged): totals of cleaning and merging a group's lines."""
    cleaned = X.remove_artifacts(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(group, pos, F.coalesce(F.col(text), F.lit("")).alias("was"), cleaned.alias("now")).filter("now <> ''")
    rows = rows.withColumn("text", X.normalize_math(F.col("now")) if math else F.col("now"))
    merged = merge_broken(rows, group, pos).groupBy(group).agg(F.count(F.lit(1)).alias("after"))
    totals = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_lines"), F.sum((F.col("was") != F.col("now")).cast("int")).alias("artifacts"))
    return totals.join(merged, group, "left").select(group, "n_lines", "artifacts", (F.col("n_lines") - F.coalesce("after", F.lit(0))).alias("merged"))


def join_words(df: DataFrame, group: list[str], order: list[str], text: str) -> DataFrame:
    """Words of a line, in order, with single blanks between them."""
    return df.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text")))), lambda r: r["_text"]), " ").alias("text"))


def word_offsets(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, place, word, offset): words with the character at which they start, counting one blank between words."""
    split = df.select(key, F.posexplode(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).alias("place", "word"))
    before = W.partitionBy(key).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    return split.withColumn("offset", F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)))


def log_elapsed(df: DataFrame, run: str, ts: str, places: int | None = 3) -> DataFrame:
    """elapsed: seconds since the run's first entry, rounded (half up) unless places is None. Times without a zone are taken as they are, whatever the session's zone."""
    at = F.col(ts)
    if dict(df.dtypes)[ts] == "timestamp_ntz":  # a cast to timestamp would read it in the session's zone, whose clock may be put forward and back
        seconds = (at - F.lit("1970-01-01").cast("timestamp_ntz")).cast("decimal(20,6)").cast("double")
    else:
        seconds = at.cast("timestamp").cast("double")
    since = seconds - F.min(seconds).over(W.partitionBy(run))
    return df.withColumn("elapsed", since if places is None else F.round(since, places))


def synthesized_line(words: DataFrame, line: str, order: str, width: str, height: str, gap: int = 20, spread: int = 31, seed: int = 42) -> DataFrame:
    """words with x and y where they stand on a line's canvas, and its size: gaps of gap to gap + spread - 1 by hash, words centred vertically."""
    step = F.col(width) + gap + F.pmod(F.xxhash64(line, order, F.lit(seed)), F.lit(spread)).cast("int")
    every, before = W.partitionBy(line), W.partitionBy(line).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    placed = words.withColumn("x", F.coalesce(F.sum(step).over(before), F.lit(0)).cast("int")).withColumn("canvas_height", F.max(height).over(every))
    return placed.withColumn("canvas_width", F.max(F.col("x") + F.col(width)).over(every)).withColumn("y", F.floor((F.col("canvas_height") - F.col(height)) / 2).cast("int"))
