"""Packing by tiers and the memory of the encoders, without Spark."""

import random
from array import array
from collections import Counter

import public_tokenizers

from glyphmill.llm import common, packing, tokencount


def packed(lengths, groups, tasks=1):
    """Sequences {id: rows} of the documents, dealt to tasks in turn."""
    out = {}
    for task in range(tasks):
        packer = packing.Packer(packing.TIERS, task, groups)
        for doc in range(task, len(lengths), tasks):
            packer.add(doc, lengths[doc])
            if packer.count > 500:
                packer.pack(last=False)
        packer.pack(last=True)
        for row in packer.done:
            out.setdefault(row[3], []).append(row)
    return out


def mixed(n):
    rng = random.Random(8)
    return [rng.choice((1, rng.randint(1, 300), rng.randint(1, 900), rng.randint(1, 5000))) for _ in range(n)]


def test_every_tier_is_packed_without_padding():
    lengths = mixed(6000)
    sequences = packed(lengths, 3)
    covered = Counter()
    for rows in sequences.values():
        assert sum(r[2] for r in rows) == rows[0][5]  # full
        for r in rows:
            covered[r[0]] += r[2]
    assert [covered[d] for d in range(len(lengths))] == lengths
    tiers = Counter(rows[0][5] for rows in sequences.values())
    assert tiers[2048] > 100 and tiers[1024] > 100
    # short pieces alone make short windows; a long window's gap takes them first
    assert Counter(rows[0][5] for rows in packed([300] * 64, 1).values()).most_common(1)[0][0] == 512
    assert set(Counter(rows[0][5] for rows in packed([200] * 128, 1).values())) == {256}
    filled = packed([1500, 500, 48], 1)
    assert [sorted(r[0] for r in rows) for rows in filled.values()] == [[0, 1, 2]]


def test_step_groups_hold_equal_shares_of_every_tier():
    sequences = packed(mixed(20000), 7, tasks=5)
    tokens, kinds = Counter(), {}
    for rows in sequences.values():
        tokens[rows[0][6]] += rows[0][5]
        kinds.setdefault(rows[0][5], Counter())[rows[0][6]] += 1
    assert set(tokens) == set(range(7))
    assert max(tokens.values()) - min(tokens.values()) < 0.01 * sum(tokens.values()) / 7
    for tier in (2048, 1024):
        assert max(kinds[tier].values()) - min(kinds[tier].values()) <= 5  # one for each task


def test_long_texts_without_blanks_are_not_remembered():
    encoder = packing.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    counter = tokencount.PrefixCounter(public_tokenizers.path("piece_bpe_32k.model"))
    text = "".join(random.Random(5).choice("abcXYZ019+/") for _ in range(200_000)) + " 中文" * 3 + "中" * 5000
    assert len(encoder.encode(text)) == 4 * len(encoder.tokenizer.encode(text, add_special_tokens=False).ids)
    assert counter.prefix_counts([text])[0][-1] == len(counter.sp.encode(text))
    for memo in (encoder.young, encoder.words, counter.young):
        assert max(map(len, memo), default=0) <= 64


def test_one_text_of_many_words_fills_no_more_than_the_generations(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 1000)
    encoder = packing.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    units = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(5000)]
    text = " ".join(units + units[-200:] + units[:200])  # some come again, from both generations and from none
    assert encoder.encode(text) == array("I", encoder.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    for memo in (encoder.young, encoder.old, encoder.words):
        assert 0 < len(memo) <= 1000


def test_workers_forget_other_operators():
    packing.UnitEncoder.of(public_tokenizers.path("byte_bpe_50k.json"))
    common.forget_others("packing")
    assert packing._encoders
    common.forget_others("tokencount")
    assert not packing._encoders
