"""Slots for recognizers: external models that turn bytes into text.

A recognizer maps a list of byte strings to (text, confidence) pairs. It is made once in each Python worker. Rows are filtered before a slot (Python runs even where
a CASE would not ask for it), equal inputs are recognized once, and failures become values."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Recognizer = Callable[[list[bytes]], list[tuple[str, float]]]
FACTORIES: dict[str, Callable[[], Recognizer]] = {}
_made: dict[str, Recognizer] = {}


def register(name: str, factory: Callable[[], Recognizer]) -> None:
    FACTORIES[name] = factory


def stub() -> Recognizer:
    """Deterministic: the bytes as text, for tests without models."""
    return lambda items: [(b.decode("utf-8", "replace"), 0.9 if b else 0.0) for b in items]


register("stub", stub)


def called(engine: Recognizer, items: list[bytes], seconds: float | None, tries: int) -> list[tuple[str, float, str | None]]:
    """(text, confidence, error) of each item: all in one call; where that fails, item by item, each up to `tries` times. A call that takes longer than `seconds` counts as failed."""

    def ask(some: list[bytes]) -> list[tuple[str, float]]:
        if seconds is None:
            found = engine(some)
        else:
            pool = ThreadPoolExecutor(1)
            try:
                found = pool.submit(engine, some).result(seconds * len(some))
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
        if len(found) != len(some):
            raise ValueError(f"{len(found)} results for {len(some)} items")
        return found

    try:
        return [(text, float(score), None) for text, score in ask(items)]
    except Exception:  # noqa: BLE001  the items decide one by one
        pass
    out = []
    for item in items:
        for _ in range(tries):
            try:
                (text, score), error = ask([item])[0], None
                break
            except Exception as e:  # noqa: BLE001  a failed row is a value
                text, score, error = "", 0.0, f"{type(e).__name__}: {e}"
        out.append((text, float(score), error))
    return out


def recognize(df: DataFrame, factory: Callable[[], Recognizer], key: str, data: str = "data", name: str = "default", seconds: float | None = None, tries: int = 1, at_once: int = 64) -> DataFrame:
    """(key, text, confidence, error) for each row; an exception of the recognizer, or no answer within `seconds` for each item, is the row's error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _made.get(name) or _made.setdefault(name, factory())
        for batch in batches:
            items = [item or b"" for item in batch.column(data).to_pylist()]
            rows = [r for at in range(0, len(items), at_once) for r in called(engine, items[at : at + at_once], seconds, tries)]
            texts, scores, errors = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([t.strip() for t in texts], pa.string()), pa.array(scores, pa.float64()), pa.array(errors, pa.string())], [key, "text", "confidence", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, data).mapInArrow(run, f"`{key}` {kind}, text string, confidence double, error string")


def pseudo_labels(regions: DataFrame, factory: Callable[[], Recognizer], kind: str = "text_line", name: str = "pseudo") -> DataFrame:
    """Manifest records (image_path, ground_truth_text, mode, confidence, pseudo_labeled, source_page) from regions (region_id, page_id, class_name, data): those of the kind, recognized; failures and empty texts are left out."""
    lines = regions.filter(F.col("class_name") == kind)
    read = recognize(lines, factory, "region_id", "data", name).filter("error is null and text <> ''")
    return lines.select("region_id", "page_id").join(read, "region_id").select(F.concat(F.col("page_id").cast("string"), F.lit("/"), F.col("region_id").cast("string"), F.lit(".png")).alias("image_path"), F.col("text").alias("ground_truth_text"), F.lit("text").alias("mode"), "confidence", F.lit(True).alias("pseudo_labeled"), F.col("page_id").cast("string").alias("source_page"))


def recognize_once(df: DataFrame, factory: Callable[[], Recognizer], data: str = "data", name: str = "default") -> DataFrame:
    """df with text, confidence and error; equal bytes are recognized once (by SHA-256)."""
    keyed = df.withColumn("sha", F.sha2(data, 256))
    distinct = keyed.groupBy("sha").agg(F.first(data).alias("data"))
    return keyed.join(recognize(distinct, factory, "sha", "data", name), "sha")


def retry_and_fuse(first: DataFrame, factory: Callable[[], Recognizer], key: str, name: str = "retry") -> DataFrame:
    """first: (key, data, text, confidence, tag). Rows to be retried, and only those, meet a second recognizer; the fused result replaces theirs."""
    from glyphmill.functions import confidence as C

    again = recognize(first.filter(C.should_retry(F.col("tag"))), factory, key, "data", name).select(key, F.col("text").alias("text_b"), F.col("confidence").alias("score_b"))
    both = first.join(again, key, "left").withColumn("retried", F.col("text_b").isNotNull())
    no = F.lit(False)
    fused = C.fuse(F.col("text"), F.col("confidence"), no, F.col("text_b"), F.col("score_b"), no)
    pick = lambda new, old: F.when(F.col("retried"), new).otherwise(F.col(old))
    return both.withColumn("fused", fused).select(key, pick(F.col("fused.text"), "text").alias("text"), pick(F.col("fused.composite"), "confidence").alias("confidence"), pick(F.col("fused.tag"), "tag").alias("tag"), "retried")


#: The recognizer of each type of region.
ROUTES = {"text": "printed", "title": "printed", "list": "printed", "handwriting": "handwriting", "equation": "formula", "table": "table", "figure": "none"}


def route_regions(regions: DataFrame, kind: str = "type") -> DataFrame:
    """regions with engine; null for unknown types, which are read as empty texts."""
    out: Column = F.lit(None).cast("string")
    for name, engine in ROUTES.items():
        out = F.when(F.col(kind) == name, engine).otherwise(out)
    return regions.withColumn("engine", out)
