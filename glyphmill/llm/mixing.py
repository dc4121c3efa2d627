"""Mixing of sources to target weights, with built-in functions only.

Every document has a hash; each source takes the documents below its threshold. Thresholds come from nested histograms: sums of sizes by (source, upper
hash bits), aggregated before the shuffle; the bucket in which the cumulative size passes the target is the only one refined, by the next
bits, LEVELS times (36 bits: then a bucket is a document or equal rows). What is still wanted below that document goes to the one document beyond
the threshold whose size fits best (the least difference first, then the least hash that has it: two aggregates that hash), if that comes nearer to the target. No document is sorted. A target above the source's size takes every document once, and again those below the threshold for the rest.

Weights are dealt to the sources in order of their code points, null last; targets stop at `most` times the source's size, and the excess
goes to the others by weight until none is above. Both need a row for each source only.

The hash is the upper 60 bits of an MD5, so that other engines can recompute the mix. Null texts have size 0, and so are never taken. Very long texts are counted whole; empty tables give
empty results; other columns are not read (`repeat_taken` hands them on). Equal rows (same doc_id and text) share a hash and are taken together. The number of sources is small
against the documents; thresholds are broadcast only where at most BROADCAST_SOURCES rows were counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import staged

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BITS, LEVELS, HASH_BITS = 12, 3, 60
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the water level up to which nobody is full.

    A source is full if most * size <= weight * level. In order of size / weight the full ones come first; the level of the rest is what they
    leave over, divided by the weights that remain."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    every = W.partitionBy(F.lit(0))
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(every)
    levels = ranked.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # the level rises while sources are full and falls from the first one that isn't, whose level is the one sought
    levels = levels.withColumn("level", F.max("level").over(every))
    target = F.least("cap", F.col("weight") * F.col("level"))
    return levels.select("source", "source_size", target.alias("target"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def spread(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The hash that thresholds apply to: HASH_BITS bits."""
    named = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, HASH_BITS // 4), 16, 10).cast("long")


def upper(h: Column, level: int) -> Column:
    """The first BITS * level bits of a hash, as a number."""
    return F.shiftright(h, HASH_BITS - BITS * level) if level else F.lit(0).cast("long")


def thresholds(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, int]:
    """(source, source_size, target, rounds, bound, extra), a row for each source, from (source, size, h); and how many rows.

    A document is taken `rounds` times, and once more if the upper bits of its hash are below `bound` or the hash is `extra`."""
    goal = staged(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumn("id", F.monotonically_increasing_id()), "targets")
    n = goal.count()
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("rounds", rounds).withColumn("want", F.col("target") - F.col("rounds") * F.col("source_size"))
    mixed = sizes.join(small(goal.select(F.col("source").alias("of"), "id"), n), F.col("source").eqNullSafe(F.col("of"))).select("id", "size", "h")
    # edge: the refined bucket (its upper bits) of each source; under: the words below it
    edges = goal.select("id", "want", F.lit(0).cast("long").alias("under"), F.lit(0).cast("long").alias("edge"))
    for level in range(1, LEVELS + 1):
        inside = mixed.select("id", "size", upper(F.col("h"), level).alias("bucket"), upper(F.col("h"), level - 1).alias("outer"))
        inside = inside.join(small(edges.select(F.col("id").alias("of"), "edge"), n), (F.col("id") == F.col("of")) & (F.col("outer") == F.col("edge")))
        histogram = inside.groupBy("id", "bucket").agg(F.sum("size").alias("words"))
        summed = histogram.withColumn("upto", F.sum("words").over(W.partitionBy("id").orderBy("bucket")))
        summed = summed.join(small(edges.select(F.col("id").alias("of"), "want", "under"), n), F.col("id") == F.col("of"))
        # the first bucket with which the words reach what is wanted
        crossing = summed.filter(F.col("under") + F.col("upto") >= F.col("want")).groupBy("id", "want").agg(F.min(F.struct("bucket", "upto", "words", "under")).alias("at"))
        edges = staged(crossing.select("id", "want", (F.col("at.under") + F.col("at.upto") - F.col("at.words")).alias("under"), F.col("at.bucket").alias("edge"), F.col("at.words").alias("words")), "edges")
    # what is still wanted goes to the one document beyond the threshold that fits best, if that comes nearer
    last = edges.filter("want > 0").select(F.col("id").alias("of"), F.col("edge").alias("bound"), (F.col("want") - F.col("under")).alias("gap"))
    beyond = mixed.join(small(last, n), (F.col("id") == F.col("of")) & (upper(F.col("h"), LEVELS) >= F.col("bound")))
    off = F.abs(F.col("gap") - F.col("size"))
    beyond = beyond.filter("size > 0").select("id", "bound", "gap", off.alias("off"), "h")
    nearest = staged(beyond.groupBy("id").agg(F.min("off").alias("least")).withColumnRenamed("id", "_id"), "nearest")
    fits = beyond.join(small(nearest, n), (F.col("id") == F.col("_id")) & (F.col("off") == F.col("least"))).groupBy("id", "bound", "gap").agg(F.min("h").alias("extra"))
    fits = staged(fits.withColumnRenamed("id", "of"), "fits")
    real = mixed.join(small(fits.select("of", "extra"), n), (F.col("id") == F.col("of")) & (F.col("h") == F.col("extra"))).groupBy("of").agg(F.sum("size").alias("words"))  # equal rows go together
    last = fits.join(small(real.withColumnRenamed("of", "_of"), n), F.col("of") == F.col("_of"), "left").select("of", "bound", F.when(F.col("words") < 2 * F.col("gap"), F.col("extra")).alias("extra"))
    out = goal.join(small(last, n), F.col("id") == F.col("of"), "left")
    return out.select("source", "source_size", "target", "rounds", F.coalesce("bound", F.lit(0)).cast("long").alias("bound"), "extra"), n


def times(rounds: str = "rounds", bound: str = "bound", extra: str = "extra", h: Column | None = None) -> Column:
    """How often a document is taken."""
    h = F.col("h") if h is None else h
    return F.col(rounds) + F.when((upper(h, LEVELS) < F.col(bound)) | F.coalesce(h == F.col(extra), F.lit(False)), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row."""
    sizes = staged(docs.select("doc_id", "source", words(F.col("text")).alias("size"), spread().alias("h")), "sizes")
    plan, n = thresholds(sizes, weights, share, most)
    joined = sizes.join(small(plan.withColumnRenamed("source", "of"), n), F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "size", "source_size", "target", (times() * F.col("size")).cast("long").alias("taken"))


def repeat_taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs as the mix takes them: every row as often as its source's threshold says."""
    sizes = staged(docs.select("source", words(F.col("text")).alias("size"), spread().alias("h")), "sizes")
    plan, n = thresholds(sizes, weights, share, most)
    plan = plan.select(F.col("source").alias("_mix_of"), F.col("rounds").alias("_mix_rounds"), F.col("bound").alias("_mix_bound"), F.col("extra").alias("_mix_extra"))
    joined = docs.join(small(plan, n), docs["source"].eqNullSafe(F.col("_mix_of")))
    return joined.withColumn("_mix_n", F.explode(F.array_repeat(F.lit(0), times("_mix_rounds", "_mix_bound", "_mix_extra", spread()).cast("int")))).select(*docs.columns)


#: The same mix for DuckDB: thresholds from one running total over the hash's upper 36 bits.
ORACLE_SQL = """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1), w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM l)) AS target FROM l), t AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM g), a AS (SELECT *, target - rounds * source_size AS want FROM t),
m AS (SELECT d.*, d.h >> 24 AS b, source_size, target, rounds, want FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source), c AS (SELECT source, want, b, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY b) AS upto FROM m GROUP BY 1, 2, 3),
e AS (SELECT source, min(b) AS bound, arg_min(want - (upto - words), b) AS gap FROM c WHERE want > 0 AND upto >= want GROUP BY 1), f AS (SELECT e.source, bound, gap, arg_min(h, (abs(gap - size), h)) AS extra FROM m JOIN e ON m.source IS NOT DISTINCT FROM e.source WHERE b >= bound AND size > 0 GROUP BY 1, 2, 3),
r AS (SELECT f.source, bound, CASE WHEN sum(size) < 2 * any_value(gap) THEN any_value(extra) END AS extra FROM f JOIN m ON m.source IS NOT DISTINCT FROM f.source AND m.h = f.extra GROUP BY 1, 2)
SELECT doc_id, size, source_size, target, CAST((rounds + CASE WHEN b < coalesce(bound, 0) OR coalesce(h = extra, false) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM m LEFT JOIN r ON m.source IS NOT DISTINCT FROM r.source"""
