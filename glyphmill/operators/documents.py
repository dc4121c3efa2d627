"""Nested output documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import solution_steps


def blocks(lines: DataFrame) -> DataFrame:
    """lines (document_id, page_number, pos, kind, raw_text, latex, confidence, bounding_box) with a block struct; latex falls back to the raw text."""
    latex = F.coalesce(F.when(F.col("latex") != "", F.col("latex")), F.col("raw_text"))
    block_id = F.sha2(F.concat_ws("/", F.col("document_id").cast("string"), F.col("page_number").cast("string"), F.col("pos").cast("string")), 256)
    none = F.lit(None)
    block = F.struct(F.substring(block_id, 1, 32).alias("block_id"), F.col("kind").alias("type"), "raw_text", latex.alias("latex"), none.cast("string").alias("problem_type"), none.cast("string").alias("subject"), none.cast("array<string>").alias("solution_steps"), "confidence", "bounding_box")
    return lines.withColumn("block", block)


def documents(lines: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(document_id, pages, metadata): pages in order with their blocks in order. metadata: (document_id, page_number, subject, grade_level, questions); subject and
    grade of the first page, `unknown` where missing, questions summed."""
    pages = blocks(lines).groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("rows")).select("document_id", F.struct("page_number", F.transform("rows", lambda r: r["block"]).alias("blocks")).alias("page"))
    docs = pages.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("page.page_number").alias("n"), F.col("page.blocks").alias("blocks")))), lambda p: F.struct(p["n"].alias("page_number"), p["blocks"].alias("blocks"))).alias("pages"))
    if metadata is None:
        return docs.withColumn("metadata", F.struct(F.lit("unknown").alias("subject"), F.lit("unknown").alias("grade_level"), F.lit(0).cast("bigint").alias("total_questions")))
    said = page_metadata(metadata)
    return docs.join(said, "document_id", "left").withColumn("metadata", F.struct(F.coalesce("subject", F.lit("unknown")).alias("subject"), F.coalesce("grade_level", F.lit("unknown")).alias("grade_level"), F.coalesce("total_questions", F.lit(0)).cast("bigint").alias("total_questions"))).select("document_id", "pages", "metadata")


def page_metadata(metadata: DataFrame) -> DataFrame:
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return metadata.groupBy("document_id").agg(F.min_by(blank("subject"), "page_number").alias("subject"), F.min_by(blank("grade_level"), "page_number").alias("grade_level"), F.sum("questions").alias("total_questions"))


def to_json(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("json"))


def linearized(lines: DataFrame, group: str, pos: str, text: str, kind: str | None = None) -> DataFrame:
    """(group, prompt): `Block i [type]: text` lines for a language model."""
    label = F.col(kind) if kind else F.lit("text")
    rows = F.array_sort(F.collect_list(F.struct(pos, label.alias("kind"), F.col(text).alias("said"))))
    said = F.transform(rows, lambda r, i: F.concat(F.lit("Block "), i.cast("string"), F.lit(" ["), r["kind"], F.lit("]: "), r["said"]))
    return lines.groupBy(group).agg(F.concat(F.array_join(said, "\n"), F.lit("\n")).alias("prompt"))


def parsed_reply(reply: Column, schema: str) -> Column:
    """struct(value, error) of a model's JSON reply."""
    value = F.from_json(reply, schema)
    return F.struct(value.alias("value"), F.when(value.isNull(), "unreadable reply").alias("error"))


def steps_of(reply: Column) -> Column:
    """A JSON list of steps, else the non-blank lines."""
    listed = F.from_json(reply, "array<string>")
    return F.when(F.trim(reply).startswith("[") & listed.isNotNull(), listed).otherwise(solution_steps(reply))


def front_matter(text: Column, metadata: Column) -> Column:
    """Markdown with `key: value` lines from a map before it."""
    lines = F.transform(F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.when(F.size(metadata) > 0, F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), text)).otherwise(text)
