"""Substring duplicates by content-defined chunking.

A gear hash (h = 2h + G[byte], 16-bit register, so a window of 16 bytes) runs over the text's bytes. A place where a word starts is a cut if the hash
there is below a quarter of its range and no cut candidate stands within the words just before; inside very long words every UTF-8 character start is a possible cut, at a lower rate. Chunks
longer than MOST_WORDS words are cut from their start on. All rules look only at nearby bytes, so after an insertion the
chunks are soon the same again.

Chunks are deduplicated by a 64-bit digest: the first occurrence (smallest doc_id, then place) keeps its text. Chunks that have an earlier occurrence and
touch form a span; it is a repeat if it has at least LEAST_WORDS words, half of which follow each other in one earlier document in the same way. (Single short chunks recur by chance;
runs of such length do not.) A chance collision of digests would need several in a row.

A repeated chunk's rows meet only in a partial aggregate (the smallest place) and in a join whose other side has one row for each digest, which adaptive
execution splits where it is skewed. Only chunks that occur twice reach the windows, which are by document.

Rows without doc_id or text take no part and stay as they are. Repeated rows (same doc_id and text) count as one occurrence; rows that share a doc_id but not their text are told apart by a hash of
it. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import arrow_map, staged, told_apart

MOST_WORDS, LEAST_WORDS, QUIET_WORDS = 16, 16, 1
#: A cut's share of word starts, of character starts inside long words, and what a long word is (bytes).
WORD_RATE, CHAR_RATE, LONG_WORD = 1 / 4, 1 / 32, 64
#: Texts are told apart by so many bits of their hash; the other 40 of the number are the place.
PLACE_BITS = 40


def gear_table() -> np.ndarray:
    """256 numbers of 16 bits, by a multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.uint16)


GEAR = gear_table()
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """The register after each byte, as the byte-wise recurrence gives it: sums over windows of 2, 4, 8 and 16 bytes."""
    h = GEAR[raw]
    for width in (1, 2, 4, 8):
        shifted = h[:-width] << np.uint16(width)
        h = h.copy()
        h[width:] += shifted
    return h


def cuts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the chunks, words of each chunk). Chunk i ends where the next one starts."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = WHITE[raw]
    word = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    if not len(word):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    h = gear_hash(raw)
    mixed = lambda at: (h[at - 1] * np.uint16(40503)) ^ (h[at - 1] >> np.uint16(7))
    inner = word[1:]
    number = np.arange(1, len(word))  # of the word that starts at a place
    hit = mixed(inner) < int(65536 * WORD_RATE)
    places, numbers = inner[hit], number[hit]
    quiet = np.diff(numbers, prepend=-QUIET_WORDS - 1) > QUIET_WORDS  # no candidate just before
    places, numbers = places[quiet], numbers[quiet]
    # forced cuts, counted from the cut before
    edges = np.concatenate(([0], numbers, [len(word)]))
    extra = np.maximum(np.diff(edges) - 1, 0) // MOST_WORDS
    if extra.any():
        add = np.repeat(edges[:-1], extra) + MOST_WORDS * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
        numbers = np.sort(np.concatenate((numbers, add)))
        places = word[numbers]
    starts = np.concatenate(([0], places))
    # inside very long words
    ends = np.concatenate((word[1:], [n]))
    long = np.flatnonzero(ends - word > LONG_WORD)
    if len(long):
        inside = np.concatenate([np.arange(word[i] + 16, ends[i]) for i in long])
        inside = inside[(raw[inside] & 0xC0) != 0x80]
        inside = inside[mixed(inside) < int(65536 * CHAR_RATE)]
        starts = np.union1d(starts, inside)
    words = np.diff(np.searchsorted(word, np.concatenate((starts, [n]))))
    return starts, words


def chunks(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, place, size, words) of every chunk; place: some bits of the text's hash, then the chunk's first byte. size in bytes;
    words is negative (-1 - words) where the same text has an earlier copy of the chunk."""
    from xxhash import xxh3_64_intdigest

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        digests, rows, places, sizes, counts = [], [], [], [], []
        for row, text in enumerate(batch.column("text").cast(pa.large_binary())):
            data = text.as_py()
            starts, words = cuts(np.frombuffer(data, np.uint8))
            if not len(starts):
                continue
            bounds = [*starts.tolist(), len(data)]
            digest = np.array([xxh3_64_intdigest(data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], np.uint64)
            again = np.ones(len(digest), bool)
            again[np.unique(digest, return_index=True)[1]] = False
            digests.append(digest.view(np.int64))
            rows.append(np.full(len(starts), row))
            places.append(starts)
            sizes.append(np.diff(bounds))
            counts.append(np.where(again, -1 - words, words))
        if not rows:
            return None
        row = np.concatenate(rows)
        tag = batch.column("tag").to_numpy(zero_copy_only=False)[row]
        place = (tag.astype(np.int64) << PLACE_BITS) | np.concatenate(places)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(digests)), batch.column("doc_id").take(pa.array(row)), pa.array(place), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(counts).astype(np.int32))], ["digest", "doc_id", "place", "size", "words"])

    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", tagged().alias("tag"))
    return arrow_map(rows, f"digest bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, place bigint, size int, words int", work)


def tagged():
    """20 bits of the text's hash."""
    return F.shiftrightunsigned(F.xxhash64("text"), 44)


def repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, tag, start, length, n_words, source_doc_id): the spans, in UTF-8 bytes, that an earlier place already holds; source_doc_id is the document that holds most of it."""
    own = chunks(docs)
    first = own.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1").select(F.col("digest").alias("of"), "first_doc")
    first = staged(first, "first")  # with an exchange of its own, the join's skewed side can be split
    later = own.join(first, F.col("digest") == F.col("of")).filter((F.col("words") < 0) | (F.col("doc_id") > F.col("first_doc")))
    base = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    words = F.when(F.col("words") < 0, -1 - F.col("words")).otherwise(F.col("words"))
    found = later.select("doc_id", F.shiftrightunsigned("place", PLACE_BITS).alias("tag"), base.alias("start"), "size", words.alias("words"), "first_doc")
    order = W.partitionBy("doc_id", "tag").orderBy("start")
    found = found.withColumn("before", F.lag("start").over(order)).filter("before is null or before <> start")  # equal rows count once
    new = F.coalesce(F.lag(F.col("start") + F.col("size")).over(order) != F.col("start"), F.lit(True))
    runs = found.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    by_source = runs.groupBy("doc_id", "tag", "run", "first_doc").agg(F.min("start").alias("start"), F.sum("size").alias("length"), F.sum("words").alias("words"))
    # of the sources that hold most words the smallest; ids may be numbers or texts
    most = F.min(F.struct((-F.col("words")).alias("less"), "first_doc")).alias("most")
    spans = by_source.groupBy("doc_id", "tag", "run").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.sum("words").alias("n_words"), most)
    spans = spans.filter((F.col("n_words") >= least) & (-2 * F.col("most.less") >= least))
    return spans.select("doc_id", "tag", "start", "length", "n_words", F.col("most.first_doc").alias("source_doc_id"))


def trim(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """docs without the repeated spans; n_chars, if there, follows the text. A document of which nothing but white space is left goes."""
    found = staged(repeats(docs, least), "repeats")
    spans = found.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("_cut_spans"))
    spans = spans.select(F.col("doc_id").alias("_cut_id"), F.col("tag").alias("_cut_tag"), "_cut_spans")
    # texts of documents without a span don't move
    touched, rest = told_apart(docs, found.select("doc_id"), "doc_id")
    joined = touched.join(spans.hint("merge"), (F.col("doc_id") == F.col("_cut_id")) & (tagged() == F.col("_cut_tag")), "left").select(*docs.columns, "_cut_spans")
    n_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    text_at = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        cols, texts, keep = batch.columns[:-1], batch.column("text").to_pylist(), np.ones(batch.num_rows, bool)
        cut = batch.columns[-1]
        changed = np.flatnonzero(cut.is_valid().to_numpy(zero_copy_only=False))
        for i in changed.tolist():
            data, at, parts = texts[i].encode(), 0, []
            for span in cut[i].as_py():
                parts.append(data[at : span["start"]])
                at = span["start"] + span["length"]
            parts.append(data[at:])
            texts[i] = b"".join(parts).decode()
            keep[i] = bool(texts[i].strip())
        if len(changed):
            cols[text_at] = pa.array(texts, cols[text_at].type)
            if n_chars is not None:
                sizes = cols[n_chars].to_pylist()
                for i in changed.tolist():
                    sizes[i] = len(texts[i])
                cols[n_chars] = pa.array(sizes, cols[n_chars].type)
        out = pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])
        return out if keep.all() else out.filter(pa.array(keep))

    return arrow_map(joined, docs.schema, work).unionByName(rest)
