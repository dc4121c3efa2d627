"""Manifests: unions, splits, lookups between sample tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def shuffle_key(key: str, seed: int = 42) -> Column:
    """A reproducible pseudo-random order of rows, the same in every engine that has MD5."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def split(df: DataFrame, key: str, shares: tuple[float, float] = (0.8, 0.1), names: tuple[str, str, str] = ("train", "val", "test"), cumulative: bool = False, seed: int = 42) -> DataFrame:
    """df with `partition`: exact shares of a shuffled order, boundaries rounded down.

    The row number that decides is found from counts of hash buckets and ranks within one bucket, so no task sees all rows: 4096 buckets by the first three
    digits of the shuffle key, their running totals (a small table), and a rank within each bucket."""
    rows = df.withColumn("_key", shuffle_key(key, seed)).withColumn("_bucket", F.substring("_key", 1, 3))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_in"))
    before = counts.withColumn("_before", F.sum("_in").over(W.orderBy("_bucket")) - F.col("_in")).withColumn("_all", F.sum("_in").over(W.partitionBy(F.lit(0)))).drop("_in")
    placed = rows.join(F.broadcast(before), "_bucket")  # at most 4096 rows
    n = F.row_number().over(W.partitionBy("_bucket").orderBy("_key", key)) + F.col("_before")
    first = F.floor(F.col("_all") * shares[0] + 1e-9)
    second = F.floor(F.col("_all") * (shares[0] + shares[1]) + 1e-9) if cumulative else first + F.floor(F.col("_all") * shares[1] + 1e-9)
    placed = placed.withColumn("_n", n)
    return placed.withColumn("partition", F.when(F.col("_n") <= first, names[0]).when(F.col("_n") <= second, names[1]).otherwise(names[2])).select(*df.columns, "partition")


def keep_listed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; all rows if nothing is listed."""
    if ids.limit(1).count() == 0:
        return df
    return df.join(ids.select(key).distinct(), key, "left_semi")


def with_group(df: DataFrame, children: DataFrame, key: str, columns: list[str], order: list[str], name: str = "items") -> DataFrame:
    """df with the array of its children in order; an empty one where there are none. Children without a parent are dropped."""
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias(name))
    kind = grouped.schema[name].dataType.simpleString()
    return df.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def lookup(df: DataFrame, names: DataFrame, key: str, name: str, default: str = "unknown") -> DataFrame:
    return df.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def last_text(table: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """(key, text): the last entry of each key, if not blank."""
    return table.groupBy(key).agg(F.max_by(text, order).alias(text)).filter(F.trim(text) != "")


def by_position(df: DataFrame, lines: DataFrame, idx: str, line_no: str) -> DataFrame:
    """Rows with the line that their index names; indexes beyond the lines are dropped."""
    return df.join(lines, F.col(idx) == F.col(line_no), "inner")


def checked_zip(a: DataFrame, b: DataFrame, pos: str) -> DataFrame:
    """Row by row; ValueError if the tables differ in length."""
    if a.count() != b.count():
        raise ValueError("tables of different lengths")
    return a.join(b, pos)


def merge_results(texts: DataFrame, formulas: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Texts and formulas in one table with kind and display; a missing confidence is 0.9."""
    t = texts.withColumn("kind", F.lit("text")).withColumn("display", F.lit(False))
    f = formulas.withColumnRenamed("latex", "text").withColumn("kind", F.lit("math"))
    return t.unionByName(f, allowMissingColumns=True).withColumn("confidence", F.coalesce("confidence", F.lit(confidence))).withColumn("display", F.coalesce("display", F.lit(False)))
