"""SimHash, substrings, token counts, packing, language, mixing: against brute force and planted cases."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphmill.llm import langid, mixing, packing, simhash, substring, tokencount

EDGES = [None, "", " \n\t", "a", "A b", "same text here", "same text here", "x" * 5000, "ééé 漢字 😀", "▁odd", "<|endoftext|> it's\n\n  two"]
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, make, prose):
    rng = random.Random(1)
    base = prose(rng, 300)
    texts = EDGES + [base, base + " end", base.upper(), prose(rng, 300)]
    docs = make(texts)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    assert [got[i].component_id for i in range(len(texts))] == root


@pytest.mark.parametrize("block", [2048, 7])
def test_links_of_a_hot_shard(spark, monkeypatch, block):
    """Many fingerprints around few centres: the same components as by comparing all, also when shards are split."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres for _ in range(60)} | {int(x) for x in rng.integers(0, 1 << 63, 50, dtype=np.uint64)}
    fps = sorted(fps)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    points = spark.createDataFrame([(x,) for x in signed], "fp long")
    from glyphmill.llm.components import components

    got = {r.node: r.root for r in components(simhash.near_links(points)).collect()}
    label = {x: x for x in signed}
    pairs = [(signed[i], signed[j]) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    for _ in range(80):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {x: got.get(x, x) for x in signed} == label


def test_keep_one(spark, make):
    docs = make(["a b c d", "a b c d", "other words stand here", None, ""], ids=[3, 1, 2, None, 7])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 7), (True, 0)]
    twice = docs.union(docs)
    assert sorted(r.doc_id for r in simhash.keep_one(twice.filter("doc_id is not null")).collect()) == [1, 2, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_planted_passage_is_cut_once(spark, make, prose):
    rng = random.Random(2)
    passage = prose(rng, 60)
    clean = [prose(rng, 150) for _ in range(6)]
    texts = [f"{clean[0]} {passage} {clean[1]}", f"{clean[2]}\n{passage}\n{clean[3]}", clean[4], f"{passage} {clean[5]}", None, "", "one", "x" * 3000]
    docs = make(texts)
    spans = substring.repeats(docs).collect()
    assert {r.doc_id for r in spans} == {1, 3} and {r.source_doc_id for r in spans} == {0}
    for r in spans:
        cut = texts[r.doc_id].encode()[r.start : r.start + r.length].decode()
        assert cut.strip() in passage and len(cut.split()) >= 30
    out = {r.doc_id: r for r in substring.trim(docs).collect()}
    assert len(out) == len(texts) and all(out[i].text == texts[i] for i in (0, 2, 4, 5, 6, 7))
    assert passage not in out[1].text and out[1].text.startswith(clean[2]) and out[1].text.endswith(clean[3]) and out[1].n_chars == len(out[1].text)
    assert substring.trim(docs).columns == docs.columns
    assert substring.repeats(docs.limit(0)).count() == 0


def test_repeats_of_equal_rows_and_ids(spark, make, prose):
    rng = random.Random(5)
    text = prose(rng, 100)
    assert substring.repeats(make([text, text], ids=[4, 4])).count() == 0  # one occurrence
    got = substring.repeats(make([text, text], ids=[4, 5])).collect()
    assert [(r.doc_id, r.n_words) for r in got] == [(5, 100)]
    assert [r.doc_id for r in substring.trim(make([text, text, text], ids=[4, 5, None])).orderBy("doc_id").collect()] == [None, 4]
    inside = substring.repeats(make([f"{text} {text}"])).collect()
    assert len(inside) == 1 and inside[0].start >= len(text) / 2


def test_chunks_resist_insertions(prose):
    rng = random.Random(8)
    text = prose(rng, 400).encode()
    own = lambda t: {t[a:b] for s in [substring.cuts(np.frombuffer(t, np.uint8))[0].tolist()] for a, b in zip(s, [*s[1:], len(t)])}
    moved = own(text[:700] + b"inserted words " + text[700:])
    assert len(own(text) - moved) <= 4
    raw = np.frombuffer(text, np.uint8)
    h, want = 0, []
    for b in raw:
        h = ((h << 1) + int(substring.GEAR[b])) & 0xFFFF
        want.append(h)
    assert substring.gear_hash(raw).tolist() == want
    starts, counts = substring.cuts(np.frombuffer(b"z" * 4000, np.uint8))
    assert counts.sum() == 1 and starts[0] == 0


def test_token_counts(spark, make):
    counter = tokencount.PrefixCounter.of(PIECES)
    texts = [*EDGES, "<s> </s> 1234,567  ▁▁x", "the  end   of\nit " * 50]
    for text in texts:
        counts = counter.prefix_counts([text or ""])[0]
        step = max(1, len(text or "") // 40)
        for i in range(1, len(text or "") + 1, step):
            assert counts[i - 1] == len(counter.sp.encode(text[:i])), (text, i)
    got = {r.doc_id: r for r in tokencount.count_tokens(make(texts), PIECES, limit=10).collect()}
    for i, text in enumerate(texts):
        n = len(counter.sp.encode(text or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 10)
        assert not text or len(counter.sp.encode(text[: got[i].kept_chars])) <= 10
    stored = {r.doc_id: r.counts for r in tokencount.prefix_tables(make(texts), PIECES).collect()}
    assert stored[4] == [len(counter.sp.encode("A b"[:i])) for i in (1, 2, 3)] and stored[0] == []
    assert tokencount.count_tokens(make(texts).limit(0), PIECES).count() == 0


def test_packing_is_a_partition_of_all_ids(spark, make, prose):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [*EDGES, *[prose(rng, rng.randint(1, 900)) for _ in range(60)], "don't <|endoftext|>stop \x1c now"]
    rows = packing.pack_documents(make(texts).repartition(3), BYTES).collect()
    library = Tokenizer.from_file(BYTES)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0  # no padding at all
    assert packing.pack_documents(make(texts).limit(0), BYTES).count() == 0


def test_language(spark, make, prose):
    rng = random.Random(6)
    alphabets = {"aa": "abcde", "bb": "vwxyz"}
    said = lambda lang, n: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(n))
    langs = [rng.choice(["aa", "bb"]) for _ in range(120)]
    texts = [said(lang, rng.randint(1, 60)) for lang in langs] + [None, "", "12 !?", said("aa", 5)]
    docs = make(texts, langs=[*langs, "aa", "bb", "aa", None])
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(texts)
    for i, lang in enumerate(langs):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert [got[i].lang_pred for i in range(120, 124)] == ["und", "und", "und", "aa"] and got[120].score == 0
    assert sorted({r.doc_id for r in docs.collect()} - {r.doc_id for r in langid.keep_identified(docs).collect()}) == [120, 121, 122]
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_kernel_matches_its_definition():
    """The folded product gives K(x, landmarks) K_mm^(-1/2) W."""
    texts = [f"{a}{b} {b}{a}".encode() for a in "abcdef" for b in "uvwxyz"]
    x = np.zeros((len(texts), langid.DIM), bool)
    for row, t in zip(x, texts, strict=True):
        row[langid.cells(t)] = True
    labels = ["p" if i < 18 else "q" for i in range(36)]
    model = langid.fit(np.packbits(x, axis=1), labels, landmarks=36)
    k = x.astype(float) @ x.T / np.sqrt(np.outer(x.sum(1), x.sum(1)))
    values, vectors = np.linalg.eigh(k)
    phi = k @ (vectors / np.sqrt(np.maximum(values, 1e-12)))[:, values > 1e-6 * values[-1]]
    y = np.array([[lab == "p", lab == "q"] for lab in labels], float)
    w = np.linalg.solve(phi.T @ phi / 18 + langid.RIDGE * np.eye(phi.shape[1]) / 36, phi.T @ y / 18)
    assert np.allclose(np.clip(phi @ w, 0, 1), model.scores([t.decode() for t in texts]), atol=1e-3)


def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def test_mixing(spark, make, prose):
    rng = random.Random(7)
    n = 400
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(n)] + [None, "", "\x0b \t", texts_twice := "two words"]
    sources = [rng.choice(["hot"] * 6 + ["b", "c", "d", None, "Z", "é"]) for _ in range(n)] + ["empty", "empty", None, "b"]
    docs = make(texts, sources=sources)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts) and texts_twice
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    per = {s: sum(size[i] for i, x in enumerate(sources) if x == s) for s in set(sources)}
    goal = brute_targets(per)
    taken = dict.fromkeys(per, 0)
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == per[s] and r.target == pytest.approx(goal[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in per:
        assert abs(taken[s] - goal[s]) <= max(3, 0.02 * goal[s]), s
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    times = {}
    for r in mixing.repeat_taken(docs).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(times.get(r.doc_id, 0) * r.size == r.taken for r in rows) and mixing.repeat_taken(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
