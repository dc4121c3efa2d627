"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

For a byte-pair vocabulary the encoding of a prefix s[:i] ends with one token t, and what stands
before t is the encoding of s[:i-len(t)]. So count(i) = count(i - len(t)) + 1, and t is the only token
ending at i that can follow the last token of the shorter prefix without the two merging otherwise. One pass
over the text therefore yields the count of *every* prefix; truncation to a budget and "how
many tokens are these first n characters" are then look-ups.

No piece of the vocabulary spans the start of a white-space run, so the table of a text is the
concatenation of the tables of its segments (a run of spaces and the characters up to the
next one), each shifted by the tokens before it; segments repeat and are looked up in a memo whose bytes are bounded.
The model is checked once in each worker: it must leave texts as they are (no normalization, a blank before the text) and no piece may span a blank.

Null texts count as empty (no tokens); an empty text has no prefix. Repeated rows give repeated
results, an empty table gives an empty one, other columns are not read.
"""

from __future__ import annotations

from array import array
from functools import cached_property
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from glyphmill.llm.common import arrow_map, memos, with_text

SPACE = "▁"
#: Segments that a worker remembers in each of two generations; when the young one is full it becomes the old one.
MEMO = 400_000
#: Longer segments (texts without blanks) are not remembered, so that a generation holds at most MEMO * (5 * LONGEST + 200) bytes.
LONGEST = 64
_models: dict[str, "PrefixCounter"] = {}
memos["tokencount"] = _models.clear


class PrefixCounter:
    """Prefix tables for one sentencepiece BPE model (identity normalization, byte fallback)."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.joins: dict[tuple[str, str], bool] = {}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank) or [self.sp.encode(t, out_type=str) for t in ("\u2460", " a")] != [[SPACE, "\u2460"] if "\u2460" in self.rank else [SPACE, "<0xE2>", "<0x91>", "<0xA0>"], self.sp.encode("\u2581a", out_type=str)]:
            raise ValueError(f"{path} normalizes texts or has pieces that span blanks")

    @classmethod
    def of(cls, path: str) -> "PrefixCounter":
        """One per worker process."""
        if path not in _models:
            _models[path] = cls(path)
        return _models[path]

    @cached_property
    def rank(self) -> dict[str, int]:
        """Order in which merges apply, by the piece that they make; -1 for the single characters that merging starts from."""
        sp = self.sp
        made = [(-sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for _, i in sorted(made)]
        return {p: -1 if len(p) == 1 else n for n, p in enumerate(pieces)}

    @cached_property
    def halves(self) -> dict[str, tuple[str, str] | None]:
        """The last merge of a piece that encodes as itself, else None; found when first asked for."""
        merge = self.merge

        class Halves(dict):
            def __missing__(self, piece: str) -> tuple[str, str] | None:
                parts = merge(piece)
                self[piece] = found = tuple(parts) if len(parts) == 2 else None
                return found

        return Halves()

    @cached_property
    def lengths(self) -> dict[str, list[int]]:
        """By the last two characters: the lengths of the pieces that end so, longest first."""
        found: dict[str, set[int]] = {}
        for piece in self.rank:
            if len(piece) > 1:
                found.setdefault(piece[-2:], set()).add(len(piece))
        return {end: sorted(sizes, reverse=True) for end, sizes in found.items()}

    def merge(self, piece: str) -> list[str]:
        """The plain merge loop until two parts are left (fewer merges: more parts); for pieces only, which are short."""
        rank, none = self.rank, 1 << 40
        parts = list(piece)
        ranks = [rank.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while len(parts) > 2 and (n := min(ranks)) < none:
            at = ranks.index(n)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank.get(parts[at] + parts[at + 1], none)
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Do a and b stay apart when encoded together?

        Merges are undone from the latest one on either side; whenever two parts that touch the border could have merged before
        the later of the merges undone so far, the border would not have survived."""
        key = (a, b)
        found = self.joins.get(key)
        if found is not None:
            return found
        if len(self.joins) > 4 * MEMO:
            self.joins.clear()
        rank, halves, before, apart = self.rank, self.halves, 1 << 40, True
        while True:
            n = rank.get(a + b)
            if n is not None and n < before:
                apart = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # the left part was made later: a merge at the border must come strictly before it
                before, a = ra, halves[a][1]
            else:  # of equal merges the left one comes first, so one at the border may equal the right part's
                before, b = rb + 1, halves[b][0]
        self.joins[key] = apart
        return apart

    def learn(self, segments: set[str]) -> dict[str, bytes]:
        """Prefix counts (int32, as bytes) of each segment, by the recurrence.

        In sorted order a segment shares its first characters with the one before, and so the rows of the table."""
        rank, halves, lengths, follows = self.rank, self.halves, self.lengths, self.follows
        found, past, last, counts = {}, "", [""], [0]
        for segment in sorted(segments):
            shared = len(commonprefix((past, segment)))
            del last[shared + 1 :], counts[shared + 1 :]
            for i in range(shared + 1, len(segment) + 1):
                for k in lengths.get(segment[i - 2 : i], ()) if i > 1 else ():
                    if k <= i and (piece := segment[i - k : i]) in rank and halves[piece] and (not (before := last[i - k]) or follows(before, piece)):
                        last.append(piece)
                        counts.append(counts[i - k] + 1)
                        break
                else:
                    char = segment[i - 1]
                    known = char in rank
                    last.append(char if known else "")  # byte fallback: nothing merges across it
                    counts.append(counts[-1] + (1 if known else len(char.encode("utf-8", "surrogatepass"))))
            past = segment
            found[segment] = array("i", counts[1:]).tobytes()
        return found

    @staticmethod
    def segments(text: str) -> list[str]:
        """The text's segments, each without the space that it starts with (the model puts one before the text)."""
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        out, run = [], ""
        for part in text.replace(SPACE, " ").split(" "):
            run += SPACE
            if part:
                out.append(run[1:] + part)
                run = ""
        if run:
            out.append(run[1:])
        return out

    def prefix_counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text: counts[i], the tokens of its first i + 1 code points."""
        young, old = self.young, self.old
        cut = [self.segments(t) if t else [] for t in texts]
        tables = [list(map(young.get, c)) for c in cut]
        fresh = {s for c, found in zip(cut, tables, strict=True) if None in found for s, b in zip(c, found, strict=True) if b is None}
        young |= {s: old[s] for s in fresh if s in old}
        once = {s[1:]: b for s, b in self.learn({SPACE + s for s in fresh if s not in young}).items()}
        young |= {s: b for s, b in once.items() if len(s) <= LONGEST}
        out = []
        for c, found in zip(cut, tables, strict=True):
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                found[at] = young[c[at]] if c[at] in young else once[c[at]]
            sizes = np.fromiter(map(len, c), np.int64, len(c)) + 1
            counts = np.frombuffer(b"".join(found), np.int32)
            totals = counts[np.cumsum(sizes) - 1].astype(np.int64)
            out.append((counts + np.repeat(np.cumsum(totals) - totals, sizes))[1:])  # the leading space is no code point of the text
        if len(young) > MEMO:
            self.young, self.old = {}, young
        return out


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and kept_chars: the code points of the longest prefix within the limit."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = PrefixCounter.of(model)
        tokens, kept = [], []
        for counts in counter.prefix_counts([t or "" for t in batch.column("text").to_pylist()]):
            tokens.append(int(counts[-1]) if len(counts) else 0)
            within = np.flatnonzero(counts <= limit)
            kept.append(int(within[-1]) + 1 if len(within) else 0)
        n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
        tokens = pa.array(tokens, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, tokens, pc.greater(tokens, limit), pa.array(kept, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(with_text(docs, "doc_id"), f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean, kept_chars bigint", work, "tokencount")


def prefix_tables(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_chars and counts: the stored table, one int for each code point, from which any budget question is answered without encoding again."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = PrefixCounter.of(model)
        rows = [c.astype(np.int32) for c in counter.prefix_counts([t or "" for t in batch.column("text").to_pylist()])]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "n_chars", "counts"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(with_text(docs, "doc_id"), f"doc_id {id_type}, n_chars bigint, counts array<int>", work, "tokencount")
