"""Writers. All go through Spark's own, so that they are distributed and retried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.manifest import split, union_all

KEYS = ("image_path", "ground_truth_text", "mode")


def manifest(df: DataFrame, path: str, mode: str | None = None, extra: tuple[str, ...] = ()) -> None:
    """JSON lines with the fixed keys (and extra ones); mode fills or replaces the column of that name."""
    if mode is not None:
        df = df.withColumn("mode", F.lit(mode))
    df.select(*KEYS, *extra).write.mode("overwrite").json(path)


def split_manifests(df: DataFrame, path: str) -> None:
    """A folder for each partition."""
    df.write.mode("overwrite").partitionBy("partition").json(path)


def training_manifest(tables: list[DataFrame], path: str, key: str = "image_path", shares: tuple[float, float] = (0.9, 0.05), seed: int = 42) -> None:
    """Union, shuffled split and write."""
    split_manifests(split(union_all(*tables), key, shares, seed=seed), path)


def json_rows(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def lines(df: DataFrame, path: str, column: str = "value", mode: str = "overwrite") -> None:
    """One text column, row by row: Markdown documents, reports, logs."""
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def lexicon(words: DataFrame, path: str) -> None:
    """One sorted JSON list. A lexicon is a bounded table; it is gathered in one row."""
    words.agg(F.to_json(F.sort_array(F.collect_set("word"))).alias("value")).write.mode("overwrite").text(path)


def tab_pairs(df: DataFrame, path: str, file: str = "file", text: str = "latex") -> None:
    """Appends `file<TAB>text` lines."""
    df.select(F.concat_ws("\t", file, text).alias("value")).write.mode("append").text(path)


def log_lines(df: DataFrame) -> DataFrame:
    """(line): `[+elapsed] LEVEL stage: message` of log rows with elapsed seconds, which should come unrounded: to three places by their binary value, ties to even, as C's %.3f (Java's rounds ties up)."""
    elapsed = F.call_function("format_number", F.col("elapsed").cast("double"), F.lit("0.000"))
    return df.select(F.format_string("[+%ss] %s %s: %s", elapsed, F.upper("level"), "stage", "message").alias("line"))


def report(status: DataFrame, path: str) -> None:
    """A status table (name, path) as JSON lines and as one Markdown list, in two folders."""
    json_rows(status, f"{path}/json")
    item = F.concat(F.lit("- **"), F.col("name"), F.lit("**: "), F.coalesce("path", F.lit("missing")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("name", item.alias("item")))), lambda r: r["item"])
    lines(status.agg(F.concat(F.lit("# Status\n\n"), F.array_join(rows, "\n")).alias("value")), f"{path}/markdown")


def crops(df: DataFrame, path: str) -> None:
    """Picture bytes by name (name, data), as a table; files of one picture each would be many small ones."""
    df.select("name", "data").write.mode("overwrite").parquet(path)
