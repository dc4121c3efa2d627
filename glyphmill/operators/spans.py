"""Matches with their places: what the built-in regular expressions don't return, as Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns and messages of the grammar check.
GRAMMAR = ((r"\b([Ii])\s+([a-z])", "Missing uppercase after 'I'"), (r"\s{2,}", "Multiple spaces"), (r"(\w)\.\s*([a-z])", "Missing uppercase after period"), (r"\b(teh|hte|adn|nad)\b", "Common misspelling"))


def grammar_errors(text: str) -> list[tuple[int, int, str, str]]:
    """(offset, length, message, context of ten characters on both sides)."""
    return [(m.start(), m.end() - m.start(), message, text[max(0, m.start() - 10) : m.end() + 10]) for pattern, message in GRAMMAR for m in re.finditer(pattern, text)]


def math_regions(text: str) -> list[tuple[int, int, str, str]]:
    """(offset, length, kind, text): display formulas, and inline ones that don't start within one."""
    found = [(m.start(), m.end(), "display") for m in re.finditer(r"\$\$(.+?)\$\$", text, re.S)]
    display = list(found)
    found += [(m.start(), m.end(), "inline") for m in re.finditer(r"\$([^$]+)\$", text) if not any(a <= m.start() < b for a, b, _ in display)]
    return [(a, b - a, kind, text[a:b]) for a, b, kind in sorted(found)]


def spans(df: DataFrame, key: str, find: Callable[[str], list[tuple[int, int, str, str]]], text: str = "text") -> DataFrame:
    """(key, offset, length, kind, context): one row for each span of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, rows = [], []
            for i, value in enumerate(batch.column(text).to_pylist()):
                found = find(value or "")
                place += [i] * len(found)
                rows += found
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(place, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True))], [key, "offset", "length", "kind", "context"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, offset int, length int, kind string, context string")


def suggested(df: DataFrame, suggestions: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Spans with the first `most` suggestions for their text, from a table (context, place, suggestion)."""
    listed = suggestions.groupBy("context").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "suggestion"))), lambda r: r["suggestion"]), 1, most).alias("suggestions"))
    return df.join(listed, "context", "left").select(key, "offset", "length", "kind", "context", F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))
