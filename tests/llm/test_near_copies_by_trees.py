"""Near copies of the pipeline's stage come through SimHash and BK-trees."""

import random

import numpy as np
import pytest
from test_resemblance import edited

from glyphmill.llm import resemblance


@pytest.mark.parametrize("blocks", [1, 2])
def test_each_member_meets_the_nearest_before_it(blocks):
    """Units of one block and of two, equal fingerprints, sizes that rule a pair out: as by comparing all."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fp = np.array([int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 16), replace=False)) for c in centres for _ in range(40)] * 2, np.uint64)
    size = len(fp)
    rows = {"unit": np.arange(size) % 3, "node": rng.permutation(size), "n": rng.choice([80, 100, 130], size), "fp": fp.view(np.int64), "role": np.full(size, 2) if blocks == 1 else rng.integers(0, 2, size)}
    i, j = resemblance.found_by_trees(rows)
    got = dict(zip(i.tolist(), j.tolist(), strict=True))
    assert len(got) == len(i)
    for x in range(size):
        near = {}
        for y in range(size):
            apart = rows["node"][y] < rows["node"][x] if blocks == 1 else rows["role"][x] == 1 and rows["role"][y] == 0
            if apart and rows["unit"][x] == rows["unit"][y] and 5 * min(rows["n"][x], rows["n"][y]) >= 4 * max(rows["n"][x], rows["n"][y]):
                near[y] = (int(fp[x]) ^ int(fp[y])).bit_count()
        near = {y: d for y, d in near.items() if d <= resemblance.RADIUS}
        assert (x in got) == bool(near)
        if near:
            assert near[got[x]] <= max(resemblance.ENOUGH, min(near.values()))


def test_fingerprints_within_two_bits_always_meet(spark, make, prose):
    """Also where not one of the min-wise bands agrees; the exact index then decides, and a text of the same bits whose index is low stays apart."""
    rng = random.Random(31)
    while True:
        base = prose(rng, 400)
        texts = [base, edited(rng, base, 1), prose(rng, 400)]
        prints = [resemblance.fingerprint(resemblance.shingle_set(t.encode())) for t in texts]
        if 0 < (prints[0] ^ prints[1]).bit_count() <= 2:
            break
    docs = make(texts)
    made = sorted(resemblance.shingled(docs).collect(), key=lambda r: r.doc_id)
    rows = [(r.node, r.n, [100 * (i + 1) + b for b in range(32)] + (r if i < 2 else made[0]).keys[32:], bytes(r.sketch), r.doc_id) for i, r in enumerate(made)]
    points = spark.createDataFrame(rows, "node long, n int, keys array<bigint>, sketch binary, first_id long")
    pair = [r.node for r in made[:2]]
    assert {(r.node, r.root) for r in resemblance.near_sets(points, docs).collect()} == {(n, min(pair)) for n in pair}
