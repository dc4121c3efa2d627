"""Near copies by BK-trees over SimHash, decided by resemblance: the Jaccard index of the sets of five-word shingles is at least 0.8.

Words and case as in simhash (A-Z lower-cased; fewer than five words: all of them as one shingle; none: the empty set). A set holds the distinct XXH64 of its shingles. Equal
sets are one node, named by 64 bits of a digest over the whole set, and are compared once.

A set's fingerprint is the SimHash of its hashes. Two sets at an index of 0.8 differ in some 10 of 64 bits, too many for bands of the fingerprint alone, so a fingerprint goes to 38 shards: the six
of `simhash`, named by pairs of its own bands (no two fingerprints within two bits fail to meet), and 32 named by bands of four min-wise values (the least of the hashes times an odd number; at an
index of 0.8 all of them differ once in some 20 million pairs, and less often above). Shards come in blocks of BLOCK, each with a BK-tree; two blocks meet in a task of its own, so that no shard is
gathered in one task. A member is paired with the first one within ENOUGH bits that its tree finds, else with the nearest within RADIUS, so a task hands on a link for each member, not the pairs.

Every pair is decided by the exact index of the two sets, in whole numbers; nothing is linked by its bits or shards alone. Components are made; where a shard is still in several of them, members of
different ones are compared once more, all of them, by their sets: the radius and the trees lose no link. (There, pairs whose share of equal min-wise values lies five deviations under 0.8 are no
candidates for the exact index.) Sets and fingerprints are made again, from the texts, for the documents that meet another one; the others keep only their shards.

Null and empty texts are near copies of each other only. Repeated rows count once; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.bktrees import PART as HASHES
from glyphmill.llm.bktrees import BKForest, majority
from glyphmill.llm.common import arrow_map, give_back, small_batches, staged, told_apart, utf8_views, with_text
from glyphmill.llm.components import components

SEED = 42
WORDS = 5
BANDS, BAND_ROWS = 32, 4
#: Shingles whose min-wise values are made at once.
PART = 2048
#: Members of a shard's block; the share of equal min-wise values that a pair needs before its sets are compared for the last time (five deviations of 0.035 under 0.8).
BLOCK, SHARE = 512, 0.62
#: Bits in which a tree's pair may differ (at an index of 0.8 it is 9.7 on average, deviation 2.9), and so few that the first such member is taken, not the nearest: it is the same in most shards.
RADIUS, ENOUGH = 16, 8
#: Shingles of a block whose sets are compared, so that a task holds some 8 MB of them (and the longest text's).
SHINGLES = 1 << 19


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, by a multiplicative rule."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


MINWISE = odd_numbers(BANDS * BAND_ROWS, 1)
MIX = odd_numbers(BAND_ROWS, 2)
BAND = odd_numbers(BANDS, 3)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - WORDS + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False)) if len(words) >= WORDS else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def node_of(hashes: np.ndarray) -> int:
    """The set's name."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(hashes.tobytes())


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes times each odd number."""
    least = np.full(len(MINWISE), ~np.uint64(0))
    for at in range(0, len(hashes), PART):
        np.minimum(least, (MINWISE[:, None] * hashes[None, at : at + PART]).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One bucket for each band."""
    rows = least.reshape(BANDS, BAND_ROWS)
    return ((rows ^ (rows >> np.uint64(29))) * MIX).sum(1, dtype=np.uint64) + BAND


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of the set."""
    return majority((hashes[at : at + HASHES] for at in range(0, len(hashes), HASHES)), len(hashes))


def shard_keys(fp: int) -> np.ndarray:
    """The six shards named by two of the fingerprint's four bands, as in simhash.near_links."""
    band = [fp >> 16 * i & 0xFFFF for i in range(4)]
    return np.array([n << 32 | band[i] << 16 | band[j] for n, (i, j) in enumerate(combinations(range(4), 2))], np.int64)


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """|a and b| / |a or b| >= 4/5 of two sorted sets; two empty sets are equal."""
    both, few = len(a) + len(b), min(len(a), len(b))
    if 9 * few < 4 * both:
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * both


def shingled(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, keys, sketch) of every row: the set's name, size and shards (none for the empty set), and the lowest byte of each min-wise value."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, keys, sketches = [], [], [], []
        for text in utf8_views(batch.column("text")):
            hashes = shingle_set(text)
            least = minwise(hashes)
            nodes.append(node_of(hashes))
            sizes.append(len(hashes))
            keys.append(np.concatenate([band_keys(least).view(np.int64), shard_keys(fingerprint(hashes))]) if len(hashes) else [])
            sketches.append((least & np.uint64(255)).astype(np.uint8).tobytes())
        named = pa.array(np.array(nodes, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), named, pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "node", "n", "keys", "sketch"])

    return arrow_map(with_text(docs, "doc_id"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node bigint, n int, keys array<bigint>, sketch binary", work)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, fp, hashes), one row for each wanted (doc_id, node): the fingerprints and the sets as bytes, made from those documents' texts only (and from all without an id)."""
    texts = with_text(docs, "doc_id")
    touched, _ = told_apart(texts, wanted.select("doc_id"), "doc_id")
    ids = wanted.select(F.col("doc_id").alias("of"), F.col("node").alias("want"))
    rows = touched.join(ids.hint("merge"), F.col("doc_id") == F.col("of")).select("want", "text")
    rows = rows.unionByName(texts.filter("doc_id is null").select(F.lit(None).cast("bigint").alias("want"), "text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        want = batch.column("want").to_pylist()
        sets = [shingle_set(text) for text in utf8_views(batch.column("text"))]
        nodes = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
        good = [i for i, w in enumerate(want) if w is None or w == nodes[i]]  # another text may share the doc_id
        fps = np.array([fingerprint(sets[i]) for i in good], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes[good]), pa.array(fps), pa.array([sets[i].tobytes() for i in good], pa.binary())], ["node", "fp", "hashes"])

    return arrow_map(rows, "node bigint, fp bigint, hashes binary", work).join(ids.select(F.col("want").alias("node")).hint("merge"), "node", "left_semi").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are near."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        of = lambda name: (np.frombuffer(x.as_py(), np.uint64) for x in batch.column(name))
        good = [near(a, b) for a, b in zip(of("a"), of("b"), strict=True)]
        return batch.select(["u", "v"]).filter(pa.array(good)) if any(good) else None

    first = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")).hint("merge")
    second = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")).hint("merge")
    return arrow_map(pairs.join(first, "u").join(second, "v").select("u", "v", "a", "b"), "u bigint, v bigint", work)


#: Columns of a unit's rows; the last two are null where trees are searched.
UNIT = ("unit", "band", "role", "node", "n", "root", "fp", "sketch", "hashes")


def alike(rows: dict, i: int, j: np.ndarray, share: float) -> np.ndarray:
    """Of the rows j those of another component than i, in size and min-wise values near enough; in a unit of one block only those after i."""
    n, node = rows["n"], rows["node"]
    j = j[(rows["root"][j] != rows["root"][i]) & (5 * np.minimum(n[j], n[i]) >= 4 * np.maximum(n[j], n[i]))]
    if rows["role"][i] == 2:
        j = j[node[j] > node[i]]
    return j[(rows["sketch"][j] == rows["sketch"][i]).mean(1) >= share] if len(j) else j


def found_by_trees(rows: dict) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): rows and the first within ENOUGH bits, else the nearest within RADIUS, of the other block, or of those before them in a unit of one block; of a size that allows the index. One BK-tree for each unit."""
    order = np.lexsort((rows["node"], rows["unit"]))
    unit, role, n, fp = (rows[c][order] for c in ("unit", "role", "n", "fp"))
    inside, points = np.flatnonzero(role != 1), fp.view(np.uint64)
    at = inside[np.lexsort((inside, n[inside], fp[inside], unit[inside]))]
    first = np.ones(len(at), bool)  # equals are searched once
    first[1:] = (unit[at[1:]] != unit[at[:-1]]) | (fp[at[1:]] != fp[at[:-1]]) | (n[at[1:]] != n[at[:-1]])
    inside = np.sort(at[first])
    kinds, root = np.unique(unit[inside], return_index=True)
    probes = np.flatnonzero((role != 0) & np.isin(unit, kinds))
    limit = np.where(role[probes] == 2, np.searchsorted(inside, probes), len(inside))
    fits = lambda q, p: 5 * np.minimum(n[probes[q]], n[inside[p]]) >= 4 * np.maximum(n[probes[q]], n[inside[p]])
    met = BKForest(points[inside], unit[inside]).nearest(points[probes], root[np.searchsorted(kinds, unit[probes])], limit, RADIUS, ENOUGH, fits)
    return order[probes[met >= 0]], order[inside[met[met >= 0]]]


def links_of(rows: dict, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join the components of a unit, each decided by the exact index. A pair is looked at in the first of its common min-wise bands only (in all its shards, if none), and not if its components are joined already."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    bands = rows["sketch"].reshape(len(rows["sketch"]), BANDS, BAND_ROWS)
    for i in left:
        j = alike(rows, i, right, SHARE)
        if len(j):
            same = (bands[j] == bands[i]).all(2)
            j = j[np.where(same.any(1), same.argmax(1), BANDS) == min(rows["band"][i], BANDS)]
        for x in j.tolist():
            u, v = top(int(rows["root"][i])), top(int(rows["root"][x]))
            if u != v and near(*(np.frombuffer(rows["hashes"][k], np.uint64) for k in (i, x))):
                above[max(u, v)] = min(u, v)
                yield i, x


def blocked(units: DataFrame, exact: bool = False) -> DataFrame:
    """(u, v): what the units' trees find, or exact links between components, from rows of UNIT. A unit holds two blocks of a shard (roles 0 and 1), or one block twice (role 2)."""

    def pairs(held: list[dict]) -> pa.RecordBatch | None:
        rows = {c: sum((h[c] for h in held), []) if c == "hashes" else np.concatenate([h[c] for h in held]) for c in held[0]}
        node, role = rows["node"], rows["role"]
        if exact:
            found = []
            for at in np.split(np.arange(len(node)), np.flatnonzero(np.diff(rows["unit"])) + 1):
                at = at[np.argsort(node[at], kind="stable")]
                found += links_of(rows, at[role[at] != 1], at[role[at] != 0])
            i, j = np.array(found, np.int64).reshape(-1, 2).T
        else:
            i, j = found_by_trees(rows)
        if not len(i):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in UNIT[:-2]}
            if exact:
                cols["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                cols["hashes"] = batch.column("hashes").to_pylist()
            cut = int(np.searchsorted(cols["unit"], cols["unit"][-1]))  # the last unit may go on in the next batch
            if cut:
                held.append({c: v[:cut] for c, v in cols.items()})
            if held and (cut or held[-1]["unit"][-1] != cols["unit"][0]):
                if (out := pairs(held)) is not None:
                    yield out
                held = []
            held.append({c: v[cut:] for c, v in cols.items()})
        if held and (out := pairs(held)) is not None:
            yield out
        held.clear()
        give_back()

    small_batches(units.sparkSession)
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "u bigint, v bigint")


def in_blocks(members: DataFrame, sizes: DataFrame, about: DataFrame) -> DataFrame:
    """Rows of UNIT from members (node, key, band, root) of the shards in sizes (of, size, shingles); about: (node, n, fp, sketch, hashes)."""
    blocks = sizes.select("of", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / SHINGLES)).cast("int").alias("blocks"))
    inside = members.join(blocks.hint("merge"), F.col("key") == F.col("of")).join(about.hint("merge"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    role = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return meets.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "band", role.alias("role"), "node", "n", "root", "fp", "sketch", "hashes")


def near_sets(points: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of the nodes that are near another one, by components; points: (node, n, keys, sketch, first_id), one row for each node, staged."""
    keyed = points.select("node", F.col("n").alias("own"), F.posexplode("keys").alias("band", "key"))
    size = [F.count(F.lit(1)).alias("size"), F.sum("own").alias("shingles")]
    shared = keyed.groupBy("key").agg(*size).filter("size > 1").withColumnRenamed("key", "of")
    shared = staged(shared, "buckets")  # with an exchange of its own, the join's skewed side can be split
    met = staged(keyed.join(shared.hint("merge"), F.col("key") == F.col("of")).select("node", "own", "key", "band"), "met")
    # the sets of all that meet another one are made once
    wanted = staged(met.select("node").distinct().join(points.hint("merge"), "node").select(F.col("first_id").alias("doc_id"), "node"), "wanted")
    sets = staged(sets_of(docs, wanted), "sets")
    none = F.lit(None).cast("binary")
    about = points.select("node", "n").join(sets.select("node", "fp").hint("merge"), "node").select("*", none.alias("sketch"), none.alias("hashes"))
    tested = staged(blocked(in_blocks(met.withColumn("root", F.col("node")), shared.withColumn("shingles", F.lit(0)), about)).distinct(), "tested")
    links = staged(confirmed(tested, sets), "near")
    roots = components(links)
    # shards that are still in several components: members of different ones
    placed = met.join(roots.hint("merge"), "node", "left").select("node", "own", "key", "band", F.coalesce("root", "node").alias("root"))
    apart = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), *size).filter("least < most").select(F.col("key").alias("of"), "size", "shingles")
    about = points.select("node", "n", "sketch").join(sets.hint("merge"), "node")
    more = staged(blocked(in_blocks(placed, staged(apart, "apart"), about), exact=True).distinct(), "near")
    return components(links.unionByName(more)) if more.limit(1).count() else roots


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, node, component_id, first_node), one row for each row of docs; component_id is the smallest non-null doc_id of the component, first_node the smallest node with it."""
    prints = staged(shingled(docs), "shingled")
    points = staged(prints.groupBy("node", "n", "keys", "sketch").agg(F.min("doc_id").alias("first_id")), "points")
    placed = points.select("node", "first_id").join(near_sets(points, docs).hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = placed.filter("first_id is not null").groupBy("root").agg(F.min(F.struct("first_id", "node")).alias("first"))
    classes = placed.join(firsts, "root", "left").select(F.col("node").alias("of"), F.col("first.first_id").alias("component_id"), F.col("first.node").alias("first_node"))
    classes = staged(classes, "classes")
    return prints.select("doc_id", "node").join(classes.hint("merge"), F.col("node") == F.col("of")).select("doc_id", "node", "component_id", "first_node")


def with_nodes(docs: DataFrame, name: str) -> DataFrame:
    """docs and the name of each row's set."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes = [node_of(shingle_set(text)) for text in utf8_views(batch.column("text"))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(nodes, np.uint64).view(np.int64))], [*batch.schema.names, name])

    return arrow_map(docs, docs.withColumn(name, F.lit(0).cast("bigint")).schema, work)
