"""SimHash near-duplicates, found with BK-trees.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of three words (repeats included; fewer words: all of them as one shingle; none:
fingerprint zero), XXH64 with seed 42; a bit is set where over half of the shingle hashes have it. Whole texts, null as empty.

Links join fingerprints at two or fewer differing bits. Copies share a fingerprint and are searched once. The 64 bits are four bands of 16; two
fingerprints within two bits agree in at least two bands, so each fingerprint goes to the six shards named by a pair of bands (32 bits), and no
link is lost. A shard holds one BK-tree (children keyed by their Hamming distance to the parent); a search with radius r follows, from a
node at distance d, only edges d - r to d + r. Shards with over BLOCK fingerprints are split: every block has its own tree, which meets each block
of the shard in a task of its own, so no task grows with a hot shard, and trees are of bounded size. Trees reach their probes through the shuffle, not
through the driver: over all shards they grow with the data. A task hands on a spanning star of the links that it found, not the pairs.

Ties and repeated rows share a fingerprint. component_id is the smallest non-null doc_id that can be reached (null only where a component has none). Empty tables
give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.bktrees import PART, BKForest, majority
from glyphmill.llm.common import arrow_map, small_batches, staged, told_apart, utf8_views, with_text
from glyphmill.llm.components import components
from glyphmill.llm.resemblance import near_copies, with_nodes

SEED = 42
RADIUS = 2
BLOCK = 2048
#: Points of a forest that is searched at once.
FOREST = 100_000


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of one text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else iter([b" ".join(words)])
    n, hashes = max(1, len(words) - 2), map(xxh64_intdigest, shingles, repeat(SEED))
    return majority((np.fromiter(hashes, "<u8", min(n - at, PART)) for at in range(0, n, PART)), n)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), fp as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.fromiter(map(fingerprint, utf8_views(batch.column("text"))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(with_text(docs, "doc_id"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint", work)


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i] in place; a label is the smallest member known so far."""
    while len(a):
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != (jump := label[label])).any():
            label[:] = jump
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]


#: What a point does in its unit.
PROBE, TREE, BOTH = 0, 1, 2


def linked(fp: np.ndarray, unit: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) stars of the links that the probes of each unit find in its tree. Units are sorted."""
    inside = np.flatnonzero(role != PROBE)
    forest = BKForest(fp[inside].view(np.uint64), unit[inside])
    kinds, first = np.unique(unit[inside], return_index=True)
    probes = np.flatnonzero((role != TREE) & np.isin(unit, kinds))
    roots = first[np.searchsorted(kinds, unit[probes])]
    label = np.arange(len(fp))
    for q, node in forest.search(fp[probes].view(np.uint64), roots, radius):
        merge_labels(label, probes[q], inside[node])
    u = np.flatnonzero(label != np.arange(len(fp)))
    return fp[u], fp[label[u]]


def near_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links that join all distinct fingerprints (column fp) within radius <= 2 bits of each other into their components."""
    if not 0 <= radius <= 2:
        raise ValueError("four bands find two or fewer differing bits")
    band = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    shards = [F.lit(n << 32).cast("long").bitwiseOR(F.shiftleft(band(i), 16)).bitwiseOR(band(j)) for n, (i, j) in enumerate((i, j) for i in range(4) for j in range(i + 1, 4))]
    keyed = points.select("fp", F.explode(F.array(*shards)).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("shard").alias("of"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = keyed.join(sizes, F.col("shard") == F.col("of")).select("fp", "shard", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"))
    # unit (i, j), i <= j: the tree of block i, probed by block j
    met = placed.select("fp", "shard", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    role = F.when(F.col("block") == F.col("other"), BOTH).when(F.col("block") < F.col("other"), TREE).otherwise(PROBE)
    units = met.select("fp", F.xxhash64("shard", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), role.cast("int").alias("role"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[np.ndarray, ...]] = []  # whole units
        tail: list[tuple[np.ndarray, ...]] = []  # the unit that may go on in the next batch

        def flush() -> pa.RecordBatch:
            u, v = linked(*(np.concatenate(x) for x in zip(*ready, strict=True)), radius)
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "unit", "role"))
            last = cols[1][-1]
            cut = int(np.searchsorted(cols[1], last))
            if cut or tail and tail[0][1][0] != last:
                ready += tail
                tail = []
            if cut:
                ready.append(tuple(c[:cut] for c in cols))
            tail.append(tuple(c[cut:] for c in cols))
            if sum(len(r[0]) for r in ready) >= FOREST:
                yield flush()
        ready += tail
        if ready:
            yield flush()

    small_batches(points.sparkSession)
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs."""
    prints = staged(fingerprints(docs), "fingerprints")
    points = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    roots = components(near_links(points.select("fp"), radius))
    named = roots.join(points, F.col("node") == F.col("fp"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = roots.join(ids, "root").select(F.col("node").alias("fp"), "component_id")
    classes = points.join(moved, "fp", "left").select(F.col("fp").alias("of"), F.coalesce("component_id", "first_id").alias("component_id"))
    classes = staged(classes, "classes")  # with an exchange of its own, the join's skewed side can be split
    return prints.join(classes, F.col("fp") == F.col("of")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near copies. Near copies are those of `resemblance`: found by BK-trees over SimHash, like the links above but farther than two bits, and decided by the exact
    index.

    The row that stays has the smallest doc_id; of several such the smallest shingle set's name decides, then the other columns, in their order. Rows that share a doc_id but
    are no near copies are told apart by their sets and all stay. Rows without a doc_id take no part and stay."""
    named = docs.filter("doc_id is not null")
    found = near_copies(named).withColumn("stays", F.expr("doc_id = component_id and node = first_node"))
    marks = staged(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("stays").alias("stays")).filter("n > 1 or stays = 0"), "marks")
    # ids of one row are decided by the id alone, and texts of ids without a mark don't move; only the rows of repeated ids are looked at again
    touched, kept = told_apart(named, marks, "doc_id")
    mark = marks.select(F.col("doc_id").alias("_mark_of"), F.col("n").alias("_mark_n"), F.col("stays").alias("_mark_stays"))
    touched = touched.join(mark.hint("merge"), F.col("doc_id") == F.col("_mark_of"), "left")
    kept = kept.unionByName(touched.filter("_mark_of is null").select(*docs.columns))
    if marks.filter("n > 1 and stays > 0").limit(1).count():
        rows = with_nodes(touched.filter("_mark_n > 1 and _mark_stays > 0").select(*docs.columns), "_node")
        own = found.filter("stays").select(F.col("doc_id").alias("_mark_of"), F.col("node").alias("_mark_first")).distinct()
        rows = rows.join(own, (F.col("doc_id") == F.col("_mark_of")) & (F.col("_node") == F.col("_mark_first"))).select(*docs.columns, "_node")
        rest = F.struct(*[rows[f"`{c}`"] for c in docs.columns if c != "doc_id"])
        one = rows.groupBy("doc_id", "_node").agg(F.min(rest).alias("row")).select("doc_id", "row.*").select(*docs.columns)
        kept = kept.unionByName(one)
    return kept.unionByName(docs.filter("doc_id is null"))
