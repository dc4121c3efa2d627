"""Near copies in the pipeline's stage: against every pair's exact index."""

import random

import numpy as np
from pyspark.sql import functions as F

from glyphmill.llm import resemblance, simhash


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 5 * len(a & b) >= 4 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return root


def edited(rng, text, n):
    w = text.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = "new" + str(rng.randint(0, 9999))
    return " ".join(w)


def test_ordinary_near_copies_leave_one(spark, make, prose):
    """One word in 112 replaced: far beyond two bits, index 0.9."""
    rng = random.Random(11)
    bases = [prose(rng, 112) for _ in range(6)]
    texts = [t for base in bases for t in (base, edited(rng, base, 1), edited(rng, base, 1))]
    assert sorted(r.doc_id for r in simhash.keep_one(make(texts)).collect()) == list(range(0, 18, 3))


def test_components_match_all_pairs(spark, make, prose):
    """Indexes on both sides of 0.8, chains of edits, short and empty texts, repeats within a text."""
    rng = random.Random(12)
    texts = [None, "", " ", "a", "A", "a b c d", "a b c d e", "a  b c D", "w " * 40, "w " * 60]
    for _ in range(4):
        base = prose(rng, 120)
        texts += [base, base.upper(), " ".join(base.split()[:60])] + [edited(rng, base, n) for n in (1, 2, 3, 4, 6)]
        for _ in range(5):  # a chain: each near the one before, the last far from the first
            texts.append(edited(rng, texts[-1], 1))
    got = {r.doc_id: r.component_id for r in resemblance.near_copies(make(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_members_far_from_their_bucket_s_smallest(spark, make, prose, monkeypatch):
    """A pair that meets only in a bucket whose smallest member is near neither of them is still linked; blocks of one member or many give the same."""
    rng = random.Random(14)
    while True:
        base = prose(rng, 104)
        texts = [" ".join(base.split()[:64]), base, " ".join(base.split()[:94])]  # 0.6 and 0.67 to the first, 0.9 to each other
        nodes = [int(np.array(resemblance.node_of(resemblance.shingle_set(t.encode())), np.uint64).view(np.int64)) for t in texts]
        if nodes[0] == min(nodes):
            break
    docs = make(texts)
    made = sorted(resemblance.shingled(docs).collect(), key=lambda r: r.doc_id)
    bands = [np.frombuffer(bytes(r.sketch), np.uint8).reshape(32, 4) for r in made]
    at = int((bands[1] == bands[2]).all(1).argmax())  # one bucket for all three, in the first band that the two share
    rows = [(r.node, r.n, [7 if b == at else 100 * (i + 1) + b for b in range(32)], bytes(r.sketch), r.doc_id) for i, r in enumerate(made)]
    points = spark.createDataFrame(rows, "node long, n int, keys array<bigint>, sketch binary, first_id long")
    for block in (512, 1):
        monkeypatch.setattr(resemblance, "BLOCK", block)
        assert {(r.node, r.root) for r in resemblance.near_sets(points, docs).collect()} == {(n, min(nodes[1:])) for n in nodes[1:]}


def test_edges(spark, make):
    assert resemblance.near_copies(make(["x"]).limit(0)).count() == 0
    assert [r.component_id for r in resemblance.near_copies(make(["a b", "a b"], ids=[None, 4])).collect()] == [4, 4]
    text = " ".join(f"w{i}" for i in range(60))
    assert [r.component_id for r in resemblance.near_copies(make([text, text + " x", text + " y z"], ids=[None, 7, None])).collect()] == [7, 7, 7]


def test_rows_of_one_id_are_decided_apart(spark, make, prose):
    """Two clean texts under one id both stay; of a unique text and a copy of a smaller id's only the unique one."""
    rng = random.Random(13)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    docs = make([a, b, c, a.upper(), d, d, c], ids=[1, 2, 2, 3, 3, 3, 9])
    docs = docs.unionByName(make([b], ids=[2]))
    kept = sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect())
    assert [x for x, _ in kept] == [1, 2, 2, 3] and {t for _, t in kept} == {a, b, c, d}
    assert simhash.keep_one(docs).columns == docs.columns
