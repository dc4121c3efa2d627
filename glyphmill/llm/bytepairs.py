"""Byte-pair encoding of many texts at once, in numpy and Arrow.

* cut: the texts of a batch, end to end as bytes, are cut into pre-tokens of the byte-level pattern by the classes of neighbouring bytes. What the classes do not settle (other
  letters than Latin ones, runs of white space, contractions, added tokens) stays together as a unit: from a single space between two non-space characters up to the next such one;
* each distinct piece is encoded once: pre-tokens by `Merges`, units by the caller;
* the pieces' ids are put in the pieces' places.

Merges: pre-tokens of about the same length are columns of one table; at each step every column merges its pair of the lowest rank, the leftmost first, as the library does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Classes of bytes; white ones are from SPACE on, and END stands beyond a text. MAYBE_*: settled by the next byte or two.
OTHER, LETTER, DIGIT, MARK, SPACE, LINE, WHITE, END, MAYBE_LATIN, MAYBE_WHITE, MAYBE_SHORT, MAYBE_ADDED = range(12)
#: Pre-tokens of more bytes are left to the caller; a place fits in the bits below a rank.
LONGEST, PLACE = 64, 6
#: Bytes of text that are worked on at a time; longer texts are parted at a space between two letters, which no pre-token crosses.
AT_ONCE, SAFE = 4 << 20, re.compile(rb"[A-Za-z](?= [A-Za-z])")
#: Columns of one table, a power of two.
COLUMNS, COLUMN_BITS = 4096, 12
NO_PAIR = 1 << 30
SLOT_BITS, SPREAD = 19, np.uint64(0x9E3779B97F4A7C15)


def byte_classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for low, high, kind in ((33, 126, MARK), (48, 57, DIGIT), (65, 90, LETTER), (97, 122, LETTER), (9, 13, WHITE), (28, 31, WHITE)):
        out[low : high + 1] = kind
    out[[32, 10, 0xC3, ord("'"), ord("<")]] = SPACE, LINE, MAYBE_LATIN, MAYBE_SHORT, MAYBE_ADDED
    out[[0xC2, 0xE1, 0xE2, 0xE3]] = MAYBE_WHITE
    return out


CLASSES = byte_classes()
#: The letters a contraction starts with.
SHORT = np.isin(np.arange(256), list(b"stmdrvl"))


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte."""
    kinds = CLASSES[data]
    later = np.flatnonzero(kinds > END)
    which = kinds[later]
    kinds[later] = OTHER
    padded = np.append(data, np.zeros(2, np.uint8))

    at = later[which == MAYBE_LATIN]
    then = padded[at + 1]
    at = at[(then >= 0x80) & (then <= 0xBF) & (then != 0x97) & (then != 0xB7)]  # neither a multiplication nor a division sign
    kinds[at] = kinds[at + 1] = LETTER

    at = later[which == MAYBE_SHORT]
    kinds[at[~SHORT[padded[at + 1]]]] = MARK

    at = later[which == MAYBE_ADDED]
    kinds[at[padded[at + 1] != ord("|")]] = MARK

    at = later[which == MAYBE_WHITE]
    one, two, three = data[at], padded[at + 1], padded[at + 2]
    short = (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
    general = (one == 0xE2) & (two == 0x80) & ((three >= 0x80) & (three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))
    long = general | (one == 0xE2) & (two == 0x81) & (three == 0x9F) | (one == 0xE1) & (two == 0x9A) & (three == 0x80) | (one == 0xE3) & (two == 0x80) & (three == 0x80)
    for n, where in ((2, at[short]), (3, at[long])):
        for k in range(n):
            kinds[where + k] = WHITE
    return kinds


def cut(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start in texts laid end to end (starts: where each text starts, none is empty), and which pieces are units that the classes do not settle."""
    kinds = classes(data)
    before, after = np.empty_like(kinds), np.empty_like(kinds)
    before[1:], after[:-1] = kinds[:-1], kinds[1:]
    before[starts] = after[starts[1:] - 1] = after[-1] = END
    space, white = kinds == SPACE, kinds >= SPACE
    piece = (kinds != before) & (before != SPACE) | space | (kinds == LINE)
    unsettled = (kinds == OTHER) | (kinds == WHITE) | white & (after >= SPACE)
    at = np.flatnonzero(piece)
    if not unsettled.any():
        return at, np.zeros(len(at), bool)
    unit = space & (before < SPACE) & (after < SPACE)
    unit[starts] = True
    whole = np.logical_or.reduceat(unsettled, np.flatnonzero(unit))
    opens, kept = unit[at], whole[np.cumsum(unit, dtype=np.int32)[at] - 1]
    stays = opens | ~kept
    return at[stays], kept[stays]


class Merges:
    """The merges of a byte-level model, for many pre-tokens at a time."""

    def __init__(self, vocab: dict[str, int], merges: list, byte_chars: dict[int, int]) -> None:
        self.ids = np.array([vocab[chr(byte_chars[b])] for b in range(256)], np.int64)
        self.none = max(vocab.values()) + 1  # the id of no token
        ranks = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ranks[vocab[left] * (self.none + 1) + vocab[right]] = rank, vocab[left + right]
        keys = np.fromiter(ranks, np.int64, len(ranks))
        rank, self.made = np.zeros(len(keys), np.int64), np.zeros(len(merges), np.int64)
        for n, (r, made) in enumerate(ranks.values()):
            rank[n], self.made[r] = r, made
        slots = self.slot(keys)
        _, first = np.unique(slots, return_index=True)
        self.keys, self.values = np.full(1 << SLOT_BITS, -1, np.int64), np.full(1 << SLOT_BITS, NO_PAIR, np.int32)
        self.keys[slots[first]], self.values[slots[first]] = keys[first], rank[first] << PLACE
        rest = np.setdiff1d(np.arange(len(keys)), first)  # pairs whose slot is taken
        rest = rest[np.argsort(keys[rest])]
        self.more_keys, self.more_values = np.append(keys[rest], np.int64(1) << 62), np.append(rank[rest] << PLACE, NO_PAIR).astype(np.int32)
        self.byte_pairs = self.pairs(np.repeat(self.ids, 256), np.tile(self.ids, 256))

    @classmethod
    def of(cls, definition: str, byte_chars: dict[int, int]) -> "Merges | None":
        """From a tokenizer's JSON; None if it is any other than plain byte-level pairs with added tokens that start with <|."""
        found = json.loads(definition)
        model, pre = found["model"], found.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain = plain and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not found.get("normalizer")
        plain = plain and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in found.get("added_tokens") or [])
        if not plain or not all(chr(c) in model["vocab"] for c in byte_chars.values()) or len(model["merges"]) >= NO_PAIR >> PLACE:
            return None
        return cls(model["vocab"], model["merges"], byte_chars)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, above the bits for its place, or NO_PAIR."""
        keys = left * (self.none + 1) + right
        slots = self.slot(keys)
        there = self.keys[slots]
        same = there == keys
        out = np.where(same, self.values[slots], np.int32(NO_PAIR))
        taken = np.flatnonzero(~same & (there >= 0))
        if len(taken):
            at = np.searchsorted(self.more_keys, keys[taken])
            found = self.more_keys[at] == keys[taken]
            out[taken[found]] = self.more_values[at[found]]
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens that lie in data, one after the other, and how many each has; quick if sizes ascend."""
        ids, counts = [], []
        for at in range(0, len(starts), COLUMNS):
            one = self.table(data, starts[at : at + COLUMNS], sizes[at : at + COLUMNS])
            ids.append(one[0])
            counts.append(one[1])
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(counts or [np.zeros(0, np.int64)])

    def table(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        longest, width = int(sizes.max()), len(starts)
        places = np.arange(longest)[:, None]
        text = data[np.minimum(starts + places, len(data) - 1)]
        # two more rows: no token stands behind the last one and before the first one
        tokens = np.full((longest + 2, COLUMNS), self.none, np.int64)
        tokens[:longest, :width] = np.where(places < sizes, self.ids[text], self.none)
        ranks = np.full((longest + 2, COLUMNS), NO_PAIR, np.int32)
        if longest > 1:
            pair = self.byte_pairs[text[:-1].astype(np.int64) << 8 | text[1:]] + places[:-1].astype(np.int32)
            ranks[: longest - 1, :width] = np.where(places[1:] < sizes, pair, NO_PAIR)
        cells = np.arange((longest + 2) << COLUMN_BITS).reshape(longest + 2, COLUMNS)
        after, before = cells + COLUMNS, cells - COLUMNS
        before[0] = cells[longest + 1]
        tokens_, ranks_, after_, before_ = (x.reshape(-1) for x in (tokens, ranks, after, before))
        while True:
            lowest = ranks[:longest, :width].min(axis=0)
            column = np.flatnonzero(lowest < NO_PAIR)
            if not len(column):
                break
            value = lowest[column].astype(np.int64)
            place = value & ((1 << PLACE) - 1)
            at = (place << COLUMN_BITS) + column
            gone = after_[at]
            right, left = after_[gone], before_[at]
            made = self.made[value >> PLACE]
            tokens_[at], tokens_[gone] = made, self.none
            ranks_[gone] = NO_PAIR
            after_[at], before_[right] = right, at
            ranks_[at] = self.pairs(made, tokens_[right]) + place
            ranks_[left] = self.pairs(tokens_[left], made) + (left >> COLUMN_BITS)
        rows = tokens[:longest, :width].T
        there = rows != self.none
        return rows[there].astype("<u4"), there.sum(axis=1)


def encode_parts(data: np.ndarray, starts: np.ndarray, merges: Merges, other: Callable[[str], bytes]) -> list[bytes]:
    """Ids of the parts of texts that lie end to end in data; starts: where each starts, none is empty."""
    at, unsettled = cut(data, starts)
    wide = len(data) >= 1 << 31
    offsets = np.append(at, len(data)).astype(np.int64 if wide else np.int32)
    pieces = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    distinct, which = pieces.dictionary.cast(pa.large_binary()), pieces.indices.to_numpy()

    offsets = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
    sizes = np.diff(offsets)
    left_out = sizes > LONGEST
    left_out[which[unsettled]] = True
    plain, rest = np.flatnonzero(~left_out), np.flatnonzero(left_out)
    plain = plain[np.argsort(sizes[plain], kind="stable")]
    ids, counts = merges.encode(np.frombuffer(distinct.buffers()[2], np.uint8), offsets[:-1][plain], sizes[plain])
    others = [other(distinct[int(n)].as_py().decode()) for n in rest]
    place = np.empty(len(distinct), np.int64)
    place[plain], place[rest] = np.arange(len(plain)), np.arange(len(plain), len(distinct))

    lengths = 4 * np.append(counts, np.array([len(x) // 4 for x in others], np.int64))
    values = pa.py_buffer(ids.tobytes() + b"".join(others))
    known = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.append(0, np.cumsum(lengths))), values])
    taken = known.take(pa.array(place[which]))
    stands, all_ids = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1], taken.buffers()[2]
    first = np.append(np.searchsorted(at, starts), len(at))  # each part's first piece
    bounds = stands[first].tolist()
    return [all_ids[low:high].to_pybytes() for low, high in pairwise(bounds)]


def encode_all(column: pa.Array, merges: Merges, other: Callable[[str], bytes]) -> list[bytes]:
    """Ids of each text (null: empty) as little-endian unsigned 32-bit bytes; other gives those of units and of long pre-tokens. About AT_ONCE bytes are worked on at a time."""
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    out: list[bytes] = [b""] * len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if ends[0] == ends[-1]:
        return out
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    parts = []  # number of the text, start and end of a stretch of it
    for n, (low, high) in enumerate(pairwise(ends.tolist())):
        while high - low > AT_ONCE and (found := SAFE.search(data, low + AT_ONCE, high)):
            parts.append((n, low, found.end()))
            low = found.end()
        if high > low:
            parts.append((n, low, high))
    at = 0
    while at < len(parts):
        low, end = parts[at][1], at + 1
        while end < len(parts) and parts[end][2] - low <= AT_ONCE:
            end += 1
        some = parts[at:end]
        for (n, _, _), ids in zip(some, encode_parts(data[low : some[-1][2]], np.array([p[1] - low for p in some]), merges, other), strict=True):
            out[n] = out[n] + ids if out[n] else ids
        at = end
    return out
