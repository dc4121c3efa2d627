"""Substring deduplication and the pipeline against plain versions, and very long texts."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_resemblance import brute_components, edited
from tokenizers import Tokenizer

import corpus_pipeline
from glyphmill.llm import langid, mixing, neighbours, simhash, substring, telephony, urls, warc


def plain_spans(rows, least=substring.LEAST_WORDS):
    """{doc_id: [(start, length, words, source)]} of (doc_id, text) rows with distinct ids, chunk by chunk."""
    cut = {}
    for doc, text in rows:
        data = text.encode()
        starts, words = substring.cuts(np.frombuffer(data, np.uint8))
        bounds = [*starts.tolist(), len(data)]
        cut[doc] = [(data[a:b], a, b - a, int(w)) for a, b, w in zip(bounds, bounds[1:], words.tolist(), strict=False)]
    first, count = {}, {}
    for doc in sorted(cut):
        for chunk, *_ in cut[doc]:
            first.setdefault(chunk, doc)
            count[chunk] = count.get(chunk, 0) + 1
    out = {}
    for doc, parts in cut.items():
        seen, run = set(), []
        for chunk, start, size, words in [*parts, (None, 0, 0, 0)]:
            later = chunk is not None and count[chunk] > 1 and (chunk in seen or doc > first[chunk])
            seen.add(chunk)
            if later:
                run.append((start, size, words, first[chunk]))
                continue
            by = {}
            for _, _, w, source in run:
                by[source] = by.get(source, 0) + w
            if run and sum(by.values()) >= least and 2 * max(by.values()) >= least:
                out.setdefault(doc, []).append((run[0][0], sum(r[1] for r in run), sum(by.values()), min(s for s, w in by.items() if w == max(by.values()))))
            run = []
    return out


def corpus(rng, prose):
    shared = [prose(rng, 70) for _ in range(4)]
    texts = [prose(rng, rng.randint(20, 200)) for _ in range(20)]
    for i in range(4, 20, 2):
        texts[i] += "\n" + shared[i % 4] + " " + prose(rng, 30)
    texts += [shared[0] + " " + prose(rng, 40) + " " + shared[0], texts[5] + " " + prose(rng, 60), "é " * 50 + shared[2]]
    return texts


def test_spans_match_a_plain_version(spark, make, prose):
    rng = random.Random(21)
    texts = corpus(rng, prose)
    docs = make(texts)
    want = plain_spans(list(enumerate(texts)))
    assert sum(map(len, want.values())) >= 8
    for table, name in ((docs, int), (docs.withColumn("doc_id", F.format_string("d%03d", "doc_id")), lambda s: int(s[1:]))):  # ids may be texts
        got = {}
        for r in substring.repeats(table).collect():
            got.setdefault(name(r.doc_id), []).append((r.start, r.length, r.n_words, name(r.source_doc_id)))
        assert {d: sorted(v) for d, v in got.items()} == want


def test_the_pipeline_matches_a_plain_version(spark, make, prose, tmp_path):
    """Language by the operator's own predictions, near copies by all pairs, repeats chunk by chunk, the mix by DuckDB, tokens by the library."""
    rng = random.Random(22)
    texts = corpus(rng, prose)
    texts += [edited(rng, texts[1], 1), texts[2].upper(), texts[3], edited(rng, texts[7], 1), None, "12 34 !!", ""]
    docs = make(texts, langs=["en"] * len(texts), sources=["abc"[i % 3] for i in range(len(texts))]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    sure = {r.doc_id for r in langid.identify(docs).collect() if r.lang_pred != "und" and r.score >= langid.LEAST_SCORE}
    kept = [i for i in range(len(texts)) if i in sure]
    root = brute_components([texts[i] for i in kept])
    kept = [i for n, i in enumerate(kept) if root[n] == n]
    spans = plain_spans([(i, texts[i]) for i in kept])
    trimmed = {}
    for i in kept:
        data, at, parts = texts[i].encode(), 0, []
        for start, length, *_ in sorted(spans.get(i, [])):
            parts.append(data[at:start])
            at = start + length
        text = b"".join([*parts, data[at:]]).decode()
        if text.strip():
            trimmed[i] = text
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(i, t, "abc"[i % 3]) for i, t in trimmed.items()])
    mix = con.execute(mixing.ORACLE_SQL)
    names = [d[0] for d in mix.description]
    times = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in (dict(zip(names, x, strict=True)) for x in mix.fetchall())}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed, tokens = {}, {}
    for r in rows:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
        tokens[r.doc_id] = r.doc_tokens
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in trimmed.items() if times[i]}
    assert tokens == want and packed == {i: n * times[i] for i, n in want.items()}


def test_very_long_texts(spark, make, prose):
    """Some 400,000 characters, with and without blanks, beside short ones: every operator takes them whole."""
    rng = random.Random(23)
    long = prose(rng, 60_000)
    solid = "".join(rng.choice("abcdef0123456789") for _ in range(400_000))
    docs = make([long, solid, "short one", long + " tail", None])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert got[3].component_id == got[0].component_id == 0 and got[0].fingerprint == f"{simhash.fingerprint(long.encode()):016x}"
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 1, 2, 4]
    spans = substring.repeats(docs).filter("doc_id = 3").agg(F.sum("length")).first()[0]
    assert spans >= 0.99 * len(long)
    assert {r.doc_id: r.size for r in mixing.mix(docs).collect()} == {0: 60_000, 1: 1, 2: 2, 3: 60_001, 4: 0}
    assert {r.lang_pred for r in langid.identify(docs).filter("doc_id < 4").collect()} == {"en"}
    media = {r.doc_id: r for r in telephony.media_features(telephony.text_media(docs)).collect()}
    assert all(media[i].n_bytes == n and media[i].pcm_bytes == 4 * media[i].payload_bytes for i, n in ((0, len(long)), (1, 400_000), (4, 0)))
    page = f"<p>{long}</p>"
    pages = spark.createDataFrame([(1, "http://x/" + "a/" * 20_000, page)], "page_id long, url string, html string").withColumn("response", F.lit(1)).withColumn("title", F.lit(2))
    assert warc.describe(warc.derive(warc.responses(pages))).first().text_words == 60_000
    assert urls.judge(pages, urls.seed_labels(spark)).first().path == "/" + "a/" * 20_000


def test_clashing_names_in_vectors(spark):
    rows = [(i, [float(i), 1.0], 1, 2) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int, cell int")
    assert [r.vec_id for r in neighbours.nearest(table, F.col("vec_id") == 0, k=2).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(ValueError):
        simhash.near_links(table.select(F.col("vec_id").alias("fp")), radius=3)
