"""What the corpus operators share: staged tables, Arrow batches, words."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import shared_folder

#: Rows in an Arrow batch; whole texts are long, so far fewer than Spark's default.
BATCH_ROWS = 1000
#: ... and bytes, so that very long texts come a few at a time.
BATCH_BYTES = 16 << 20
#: Rows of the table that tells touched keys from others, of 64 bits each: its proven bound, whatever the size of the data.
WORDS = 1 << 18
_scopes: dict[str, list[str]] = {"": []}
_scope = ""


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables staged within can be deleted together, by `drop_staged(spark, name)`."""
    global _scope
    before, _scope = _scope, name
    _scopes.setdefault(name, [])
    try:
        yield
    finally:
        _scope = before


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path."""
    path = f"{shared_folder(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation above it."""
    table, path = written(df, name)
    _scopes[_scope].append(path)
    return table


def replaced(df: DataFrame, name: str) -> DataFrame:
    """As staged, for a table that takes the place of the last one staged, which only it reads: that one is deleted."""
    last = _scopes[_scope].pop()
    table = staged(df, name)
    delete(df.sparkSession, last)
    return table


def delete(spark: SparkSession, *paths: str) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession, name: str = "") -> None:
    """Delete the tables staged in a scope; call it once the results that read them are written."""
    paths, _scopes[name] = _scopes.get(name, []), []
    delete(spark, *paths)


def told_apart(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(touched, rest): rest holds rows whose key is surely not among the keys, touched all the others.

    One plan at every size: the keys' hashes set bits in a table of at most WORDS rows, which is broadcast (some 16 MB at most). Rows of rest need not move for a join with the keys;
    touched ones are then joined exactly. The fuller the table, the more rows are touched in vain (an eighth at two million keys); none is ever lost. Rows without a key are in rest."""
    h = F.xxhash64(F.lit("touched"), F.col(key))
    word, bit = F.pmod(h, F.lit(WORDS)).cast("int"), F.shiftrightunsigned(h, 58).cast("int")
    one = keys.filter(F.col(key).isNotNull()).select(word.alias("_told_word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64('touched', `{key}`), 58) as int))").alias("_told_bit"))
    bits = staged(one.groupBy("_told_word").agg(F.bit_or("_told_bit").alias("_told_bits")), "bits")
    met = df.withColumn("_told_at", word).withColumn("_told_place", bit).join(F.broadcast(bits), F.col("_told_at") == F.col("_told_word"), "left")
    hit = F.coalesce(F.expr("shiftrightunsigned(_told_bits, _told_place) & 1L") == 1, F.lit(False)) & F.col(key).isNotNull()
    columns = [F.col(f"`{c}`") for c in df.columns]
    return met.filter(hit).select(*columns), met.filter(~hit).select(*columns)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and the bytes of an Arrow batch, unless the session already asks for fewer."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: What operators remember in a worker from batch to batch: how to forget it, by name.
memos: dict[str, Callable[[], None]] = {}


def forget_others(name: str = "") -> None:
    """A worker that serves one operator after another keeps the memory of the one at work only."""
    for other, clear in memos.items():
        if other != name:
            clear()


def give_back() -> None:
    """Freed memory goes back to the system, so that a worker that waits or serves the next operator doesn't hold what the last one needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def arrow_map(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], memo: str = "", most: int | None = None) -> DataFrame:
    """df through work, one Arrow batch at a time; empty batches are skipped. memo: the name of what work remembers. most: batches of more bytes come in slices."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(memo)
        for batch in source:
            step = max(1, batch.num_rows * most // max(most, batch.nbytes)) if most else max(1, batch.num_rows)
            for at in range(0, batch.num_rows, step):
                if (out := work(batch.slice(at, step))) is not None:
                    yield out
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(batches, schema)


def utf8_views(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def with_text(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Only the columns an operator needs, so that the scan reads no others."""
    return df.select(*keep, F.col(text).alias("text"))
