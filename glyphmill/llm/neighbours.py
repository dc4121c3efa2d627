"""Nearest neighbours from a hash-prefix forest.

Every tree hashes a vector to a string of BITS bits, one for each random hyperplane (through the mean of a bounded sample), and keeps a sorted array of these strings. A
query descends in each tree to the entries that share its longest prefix; then all trees ascend together, one bit at a time, so that
shorter prefixes add candidates, until the sum over the trees reaches `candidates` times the shard's rows (and `least`). Distances are then exact, in double precision, on the original vectors.

Layout: equal vectors are one entry that keeps the ids that can matter (the smallest k + 1, by a rank limit that Spark applies before the
shuffle), so thousands of copies cost no more than one. Entries are dealt to cells of about `shard` rows by the sides they take of a few orthogonal hyperplanes (main directions
and medians of the sample); a cell with more rows is split by hash. Each part builds its own forest, in one task.

Queries (a stated set, of any number) go to parts through the shuffle, not through the driver. In a first round each meets its own cell, which bounds the distance of its k-th neighbour from above; the
violated hyperplanes bound the distance to every other cell from below, and only cells that can hold something nearer are met in the second round. No neighbour is lost that way: on
clustered vectors few cells are met, on vectors without structure nearly all. A part with over QUERIES queries is copied, so that no task grows with them; a task holds one part and streams its queries.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part. Ties go to the smaller vec_id; repeated rows
count once, and so does an id with several vectors (as a neighbour its nearest one counts, as a query its smallest). Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import arrow_map, forget_others, small_batches, staged

TREES, BITS = 128, 32
#: Share of a shard's rows that the prefixes of all trees must add up to before a query's ascent ends (rows count once for each tree that reaches them).
CANDIDATES = 0.8
#: ... and at least that many, which small shards reach only near their roots.
LEAST = 8192
#: Rows of a part, queries of one copy of it, vectors sampled for mean and directions, hyperplanes that make cells at most, queries searched at once.
SHARD, QUERIES, SAMPLE, SPLITS, AT_ONCE = 16_384, 65_536, 4096, 24, 256
#: Tasks of a search at most; beyond, a task serves several parts, one after another.
TASKS = 100_000
SEED = 7


def usable(vector: str) -> Column:
    """Neither null nor zero, and all components finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class PrefixForest:
    """Sorted arrays of hash strings over the rows of one shard."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, trees: int = TREES, bits: int = BITS) -> None:
        self.bits = bits
        rng = np.random.default_rng(SEED)  # the same hyperplanes in every shard
        self.planes = rng.standard_normal((trees, bits, vectors.shape[1]))
        self.centre = centre
        codes = self.codes(vectors)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """trees x rows; the first hyperplane gives the highest bit."""
        centred = vectors - self.centre
        weights = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        return np.stack([(centred @ p.T > 0) @ weights for p in self.planes])

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of shape levels x trees x queries: where the entries stand that share the first n bits, n = 0 .. bits."""
        codes = self.codes(queries)
        low = np.empty((self.bits + 1, *codes.shape), np.int64)
        high = np.empty_like(low)
        for n in range(self.bits + 1):
            rest = (1 << (self.bits - n)) - 1
            for t in range(len(codes)):
                low[n, t] = np.searchsorted(self.sorted[t], codes[t] & ~rest, side="left")
                high[n, t] = np.searchsorted(self.sorted[t], codes[t] | rest, side="right")
        return low, high

    def candidates(self, queries: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the rows reached by the synchronous ascent, which ends in the tree where the ranges reached hold `least` rows together."""
        low, high = self.ranges(queries)
        size = high - low
        level = (size.sum(1) >= least).sum(0) - 1  # the longest prefixes that are enough in all trees; sums fall with the level
        seen = np.zeros(self.order.shape[1], bool)
        for q, n in enumerate(level):
            if n < 0:
                yield np.arange(len(seen))
                continue
            deeper = min(n + 1, self.bits)
            have = size[deeper, :, q].sum() + np.cumsum(size[n, :, q] - size[deeper, :, q])
            up = int(np.searchsorted(have, least)) + 1  # so many trees ascend to level n, the others stay below
            seen[:] = False
            for t in range(len(self.order)):
                m = n if t < up else deeper
                seen[self.order[t, low[m, t, q] : high[m, t, q]]] = True
            yield np.flatnonzero(seen)


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean, each from its own differences."""
    diff = vectors - query
    return np.sqrt((diff * diff).sum(1))


def search_part(forest: PrefixForest, ids: list[list[int]], vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, least: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score): the k nearest ids of the part for each query, but for the query's own."""
    out: list[tuple[int, int, float]] = []
    for q, rows in enumerate(forest.candidates(queries, least)):
        d = distances(queries[q], vectors[rows])
        own, found, n = int(query_ids[q]), {}, k + 1
        while True:  # the nearest n rows and their ties; more only where ids recur with several vectors
            near = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1]) if len(rows) > n else np.arange(len(rows))
            for i in near:
                for vec in ids[rows[i]]:
                    if vec != own and d[i] < found.get(vec, np.inf):
                        found[vec] = d[i]
            if len(found) >= k or len(near) == len(rows):
                break
            n *= 2
        out += [(own, vec, score) for score, vec in sorted((score, vec) for vec, score in found.items())[:k]]
    return out


class Cells:
    """Cells of space: the sides of orthogonal hyperplanes, as bits."""

    def __init__(self, sample: np.ndarray, splits: int) -> None:
        self.centre = sample.mean(0)
        splits = min(splits, *sample.shape)
        self.axes = np.linalg.svd(sample - self.centre, full_matrices=False)[2][:splits]
        self.middle = np.median((sample - self.centre) @ self.axes.T, axis=0)

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.centre) @ self.axes.T - self.middle

    def of(self, margins: np.ndarray) -> np.ndarray:
        return (margins > 0) @ (1 << np.arange(len(self.axes), dtype=np.int64))

    def reach(self, margins: np.ndarray, bound: float) -> np.ndarray:
        """The cells that come within the bound of a vector: the violated hyperplanes are orthogonal, so the squares of their margins add up."""
        cells, cost = self.of(margins[None]), np.zeros(1)
        for bit, square in enumerate(margins * margins):
            near = cost + square <= bound * bound * (1 + 1e-9)  # rounding must not lose a cell
            cells, cost = np.concatenate((cells, cells[near] ^ (1 << bit))), np.concatenate((cost, cost[near] + square))
        return cells


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank; Spark cuts each task's rows to n before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", candidates: float = CANDIDATES, least: int = LEAST, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, nearest first."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(vector) & F.col(vec_id).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    # -0.0 and 0.0 are equal components
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, total = sizes
    rows = rows.filter(F.size("v") == dim)
    # one entry for equal vectors: at most k + 1 of their ids can be among the k nearest of a query
    # repeated rows are one before the rank
    copies = first_by(rows.select("vec_id", "v").distinct().withColumn("key", F.xxhash64("v")), ["key", "v"], [F.col("vec_id")], k + 1)
    entries = staged(copies.groupBy("key", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "vectors")
    queries = staged(rows.filter("asked").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    sample = np.array([r.v for r in entries.orderBy("key").select("v").limit(SAMPLE).collect()]).reshape(-1, dim)  # a fit on a bounded sample
    cells = Cells(sample, min(SPLITS, max(0, int(np.ceil(np.log2(max(1, total / shard)))))))

    def placed(table: DataFrame, keep: str, kind: str) -> DataFrame:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            return pa.RecordBatch.from_arrays([batch.column(keep), batch.column("v"), pa.array(cells.of(cells.margins(v)))], [keep, "v", "cell"])

        return arrow_map(table.select(keep, "v"), f"{keep} {kind}, v array<double>, cell bigint", work)

    dealt = staged(placed(entries, "ids", "array<bigint>"), "dealt")
    parts = staged(dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("parts")).withColumnRenamed("cell", "of"), "parts")

    def searched(asked: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) from (query_id, v, cell): the k nearest of every part of the cells named."""
        met = asked.join(parts.hint("merge"), F.col("cell") == F.col("of")).select("query_id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        copies = met.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("copies"))
        copies = staged(copies.withColumnsRenamed({"cell": "in_cell", "part": "in_part"}), "copies")
        inside = (F.col("cell") == F.col("in_cell")) & (F.col("part") == F.col("in_part"))
        part = F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")
        held = dealt.join(parts.hint("merge"), F.col("cell") == F.col("of")).select("ids", "v", "cell", part.alias("part")).join(copies.hint("merge"), inside)
        held = held.select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("query_id"), "ids", "v")
        met = met.join(copies.hint("merge"), inside)
        met = met.select("cell", "part", F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), "query_id", F.lit(None).cast("array<bigint>").alias("ids"), "v")
        tasks = max(1, min(TASKS, int(copies.agg(F.sum("copies")).first()[0] or 0)))
        units = held.unionByName(met).withColumn("unit", F.xxhash64("cell", "part", "copy")).drop("cell", "part", "copy")
        small_batches(spark)
        return units.repartition(tasks, "unit").sortWithinPartitions("unit", "kind").mapInArrow(part_search(cells.centre, dim, k, candidates, least), "query_id bigint, vec_id bigint, score double")

    own = placed(queries.withColumnRenamed("vec_id", "query_id"), "query_id", "bigint")
    first = staged(searched(own), "first")
    found = first
    if len(cells.axes):
        best = first_by(first, ["query_id"], [F.col("score"), F.col("vec_id")], k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
        bound = queries.withColumnRenamed("vec_id", "query_id").join(best.filter(F.col("n") == k).select("query_id", "score"), "query_id", "left")

        def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                most = batch.column("score").fill_null(float("inf")).to_numpy(zero_copy_only=False)
                for i, (m, b) in enumerate(zip(cells.margins(v), most, strict=True)):
                    reached = cells.reach(m, b)[1:]  # but for its own
                    for at in range(0, len(reached), 4096):
                        part = pa.array(reached[at : at + 4096])
                        same = pa.array(np.full(len(part), i))
                        yield pa.RecordBatch.from_arrays([batch.column("query_id").take(same), batch.column("v").take(same), part], ["query_id", "v", "cell"])

        found = first.unionByName(searched(staged(bound.mapInArrow(beyond, "query_id bigint, v array<double>, cell bigint"), "beyond")))
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = first_by(once, ["query_id"], [F.col("score"), F.col("vec_id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def part_search(centre: np.ndarray, dim: int, k: int, candidates: float, least: int):
    """Over rows sorted by (unit, kind): a unit's entries make a forest, which its queries then meet batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        unit, ids, held, forest, vectors = None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            units, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "kind"))
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            out: list[tuple[int, int, float]] = []
            edges = np.flatnonzero((np.diff(units) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(units)], strict=True):
                if units[a] != unit:
                    unit, ids, held, forest = units[a], [], [], None
                if kinds[a] == 0:
                    ids += batch.column("ids").slice(a, b - a).to_pylist()
                    held.append(v[a:b])
                    continue
                if forest is None:
                    if not held:  # a query whose cell has no entry
                        continue
                    vectors = np.concatenate(held)
                    forest = PrefixForest(vectors, centre)
                asked = batch.column("query_id").to_numpy(zero_copy_only=False)
                for at in range(a, b, AT_ONCE):
                    end = min(b, at + AT_ONCE)
                    out += search_part(forest, ids, vectors, asked[at:end], v[at:end], k, max(least, int(candidates * len(vectors))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return run
