"""Vocabulary joins: nearest words, prefixes, coverage, corrections.

A lexicon is a table of one column, `word` (lower case). Texts meet it through their distinct words, so that the work grows with the vocabulary of the texts, not with
their length; fuzzy joins are cut by length bands, and the side that is broadcast is the lexicon, whose size is checked first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lexicons of up to so many words are broadcast; larger ones are joined by shuffled bands.
BROADCAST_WORDS = 500_000
WORD = r"(?U)\b([a-zA-Z]+)\b"


def lexicon(*sources: DataFrame) -> DataFrame:
    """Distinct lower-case words of tables with a column `word`."""
    out = sources[0].select(F.lower("word").alias("word"))
    for s in sources[1:]:
        out = out.union(s.select(F.lower("word").alias("word")))
    return out.filter("word is not null and word <> ''").distinct()


def small(words: DataFrame) -> DataFrame:
    """The lexicon, to be broadcast if it is small enough."""
    return F.broadcast(words) if words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else words


def similar(queries: DataFrame, words: DataFrame, distance: int = 2) -> DataFrame:
    """(query, word, distance) for all words within the distance of each distinct query, nearest first (place), ties by word.

    Words can only be that near if their lengths are; each query goes to the bands of length that it may meet, so the join is an equi-join."""
    asked = queries.select(F.lower("query").alias("query")).filter("query is not null").distinct()
    asked = asked.withColumn("band", F.explode(F.sequence(F.length("query") - distance, F.length("query") + distance)))
    known = small(words.select("word", F.length("word").alias("band")))
    d = F.expr(f"levenshtein(query, word, {distance})")
    found = asked.join(known, "band").withColumn("distance", d).filter("distance >= 0").drop("band")
    return found.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("distance", "word")))


def with_prefix(queries: DataFrame, words: DataFrame, n: int = 10) -> DataFrame:
    """(query, word, place): the first n words that start with each query, by an equi-join on the prefix."""
    asked = queries.select(F.lower("query").alias("query")).filter("query <> ''").distinct().withColumn("size", F.length("query"))
    # only prefixes of lengths that are asked for, each word's up to its own length
    sizes = asked.select("size").distinct()
    bound = words.filter("word <> ''").select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("size"))
    keyed = bound.join(F.broadcast(sizes), "size", "left_semi").withColumn("query", F.expr("substring(word, 1, size)"))
    met = asked.join(keyed, ["query", "size"]).select("query", "word")
    return met.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("word"))).filter(F.col("place") <= n)


def text_words(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, word, n): each text's distinct lower-case words of ASCII letters, with their counts."""
    own = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), 1)).alias("word"))
    return own.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def coverage(texts: DataFrame, words: DataFrame, key: str, text: str = "text", bias: float = 0.3, penalty: float = 0.1) -> DataFrame:
    """(key, in_vocab, total, score) of every text: bias * share of known words + 1 - bias - penalty * share of unknown ones, within [0, 1]; 1 without words."""
    known = small(words.withColumn("known", F.lit(1)))
    counts = text_words(texts, key, text).join(known, "word", "left").groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.coalesce("known", F.lit(0))).alias("in_vocab"))
    every = texts.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("in_vocab", F.lit(0)).alias("in_vocab"))
    share = F.col("in_vocab") / F.col("total")
    score = F.when(F.col("total") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share * bias + (1 - bias) - (1 - share) * penalty)))
    return every.select(key, "in_vocab", "total", score.alias("score"))


def rerank(hypotheses: DataFrame, scores: DataFrame, key: str, group: str, model: str, bias: float = 0.3) -> DataFrame:
    """hypotheses with combined score and rank in their group; scores: (key, score)."""
    both = hypotheses.join(scores.select(key, F.col("score").alias("vocabulary")), key).withColumn("combined", (1 - bias) * F.col(model) + bias * F.col("vocabulary"))
    return both.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("combined"), key)))


def unknown_words(texts: DataFrame, words: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(word, n, n_texts): words of the texts that the lexicon lacks."""
    own = text_words(texts, key, text).join(small(words), "word", "left_anti")
    return own.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_texts"))


def recased(word: Column, correction: Column) -> Column:
    """The correction in the word's case: all upper, or the first letter."""
    upper = (F.upper(word) == word) & (F.lower(word) != word)
    first = F.substring(word, 1, 1)
    return F.when(upper, F.upper(correction)).when((F.upper(first) == first) & (F.lower(first) != first), F.concat(F.upper(F.substring(correction, 1, 1)), F.lower(correction.substr(F.lit(2), F.length(correction))))).otherwise(correction)


def correct(texts: DataFrame, words: DataFrame, key: str, text: str = "text", most: int = 5, distance: int = 1) -> DataFrame:
    """(key, corrected), one row for each distinct key: unknown words become the nearest known one, the first `most` of each text; marks around them and their case stay.
    Blank and null texts become empty ones."""
    parts = texts.select(key, F.posexplode(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).alias("pos", "whole"))
    bare = r"^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$"
    parts = parts.withColumn("head", F.regexp_extract("whole", bare, 1)).withColumn("core", F.regexp_extract("whole", bare, 2)).withColumn("tail", F.regexp_extract("whole", bare, 3)).withColumn("query", F.lower("core"))
    strange = parts.filter("core <> ''").select("query").distinct().join(small(words.select(F.col("word").alias("query"))), "query", "left_anti")
    best = similar(strange, words, distance).filter("place = 1").select("query", F.col("word").alias("best"))
    met = parts.join(best, "query", "left")
    # at most so many corrections, counted along the text
    used = F.sum(F.when(F.col("best").isNotNull(), 1).otherwise(0)).over(W.partitionBy(key).orderBy("pos"))
    said = F.when(F.col("best").isNotNull() & (used <= most), recased(F.col("core"), F.col("best"))).otherwise(F.col("core"))
    met = met.withColumn("said", F.concat("head", said, "tail"))
    done = met.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda r: r["said"]), " ").alias("corrected"))
    return texts.select(key).distinct().join(done, key, "left").select(key, F.coalesce("corrected", F.lit("")).alias("corrected"))


def spelling_report(texts: DataFrame, words: DataFrame, key: str, text: str = "text", suggestions: int = 5) -> DataFrame:
    """(key, pos, offset, word, suggestions): words that the lexicon lacks, with the nearest known ones."""
    from glyphmill.operators.lines import word_offsets

    own = word_offsets(texts, key, text).withColumn("query", F.lower(F.regexp_replace("word", r"[^\p{L}\p{N}]", ""))).filter("length(query) > 2")
    strange = own.join(small(words.select(F.col("word").alias("query"))), "query", "left_anti")
    near = similar(strange.select("query"), words, 2).filter(F.col("place") <= suggestions).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("near"))
    return strange.join(near, "query", "left").select(key, F.col("place").alias("pos"), "offset", "word", F.coalesce(F.transform("near", lambda r: r["word"]), F.array().cast("array<string>")).alias("suggestions"))


def latex_vocabulary(corpus: DataFrame, constants: list[str], least: int = 2, text: str = "text") -> DataFrame:
    """(command): constants and the commands that occur at least so often, distinct."""
    spark = corpus.sparkSession
    found = corpus.select(F.explode(F.regexp_extract_all(text, F.lit(r"(\\[a-zA-Z]+)"), 1)).alias("command")).groupBy("command").count().filter(F.col("count") >= least).select("command")
    return found.union(spark.createDataFrame([(c,) for c in constants], "command string")).distinct()
