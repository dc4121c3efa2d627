"""Packing of tokenized documents into sequences of several context sizes.

Hierarchical multi-length packing, in each task over its own documents (no shuffle):

* route: a document of n tokens is cut into whole windows of the longest tier; what is left goes to the shortest tier that holds it
  (tiers are powers of two);
* pack: each tier, the longest first, is packed into sequences of its own length, each opened by a piece of that tier;
* fill: the gap of a window is closed by pieces of shorter tiers, the longest that fit first; where none fits, one is cut at the gap's end (documents may be cut
  freely), and its rest is routed again; where no shorter piece is left, the next one of the same tier is cut;
* what fills no window at a task's end is cut into powers of two, which need no padding.

Tokens are those of a `tokenizers` file without special tokens, then one end id. The texts of a batch are encoded together (`bytepairs.py`), each distinct pre-token once. What that
leaves out is encoded in units (from a single space that stands between two non-space characters up to the next such one), and so is all text by any file other than plain byte-level
pairs: no pre-token and no added token crosses such a place, so the ids of the text are those of its units, and units repeat.

balance: there are as many step groups as the bytes of all texts ask for at about `step_tokens` tokens each (one scan counts them). The sequences of each tier are dealt to all
groups in turn, in each task from a start of its own, so that every group has the same share of each tier from every task: groups differ by a sequence for each task and tier at most.

Null texts count as empty: such a document is the end id alone. Repeated rows are packed as often as they occur (each is cut into pieces of its own);
empty tables give empty results; other columns are not read. Very long units (texts without blanks) are encoded but not remembered.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.bytepairs import Merges, encode_all
from glyphmill.llm.common import forget_others, give_back, memos, small_batches, with_text

TIERS = (2048, 1024, 512, 256)
#: Units that a worker remembers in each of two generations, and pre-tokens; when the young one is full, within a text too, it becomes the old one.
MEMO = 200_000
#: Longer units are not remembered, so that a generation (and the pre-tokens) holds at most MEMO * (8 * LONGEST + 200) bytes.
LONGEST = 64
#: Bytes of text for each token, roughly; only the number of step groups depends on it.
TOKEN_BYTES = 3
#: Pre-tokens of the byte-level pattern, whatever Unicode version it knows: Latin letters, ASCII digits and marks (no apostrophe), and a line end before something else.
PLAIN = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|\n(?=\S)")


def byte_chars() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + n for n, b in enumerate(others)}


BYTE_CHARS = byte_chars()
BLANK = chr(BYTE_CHARS[32])
DOUBLE = re.compile(r"\s\s")
#: Pieces that wait to be packed; beyond, the waiting ones are packed.
WAITING = 4000
_encoders: dict[str, "UnitEncoder"] = {}
memos["packing"] = _encoders.clear


class UnitEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.merges = Merges.of(Path(path).read_text("utf-8"), BYTE_CHARS)
        give_back()  # what reading the file took

    @classmethod
    def of(cls, path: str) -> "UnitEncoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    @staticmethod
    def units(text: str) -> list[str]:
        """The text's units; all but the first without their leading space."""
        parts = text.split(" ")
        if not DOUBLE.search(text):
            return parts
        out, open_ = [parts[0]], not parts[0] or parts[0][-1].isspace()
        for part in parts[1:]:
            if open_ or not part or part[0].isspace():  # in or beside a longer run of white space
                out[-1] += " " + part
                open_ = not part or part[-1].isspace()
            else:
                out.append(part)
                open_ = part[-1].isspace()
        return out

    def word(self, text: str) -> bytes:
        """Ids of one pre-token, straight from the library's model."""
        found = self.words.get(text)
        if found is None:
            if len(self.words) >= MEMO:
                self.words.clear()
            plain = text.replace(" ", BLANK) if text.isascii() and text.isprintable() else text.encode("utf-8").decode("latin-1").translate(BYTE_CHARS)
            tokens = self.model.tokenize(plain)
            found = array("I", [t.id for t in tokens]).tobytes()
            if len(text) <= LONGEST:
                self.words[text] = found
        return found

    def whole(self, unit: str) -> bytes:
        """Ids of one unit: by pre-tokens where these are plain (and no added token can be in it), else by the library."""
        parts = PLAIN.findall(unit)
        if "<|" in unit or "".join(parts) != unit:
            return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.word, parts))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = self.units(text)
        young, old = self.young, self.old
        found, at = list(map(young.get, rest)), -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            unit = rest[at]
            found[at] = ids = young.get(unit) or old.get(unit) or self.whole(" " + unit)
            if len(unit) <= LONGEST:
                if len(young) >= MEMO:
                    self.young, self.old = young, old = {}, young
                young[unit] = ids
        return (self.whole(first) if first else b"") + b"".join(found)

    def encode_all(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a column; null counts as empty."""
        if self.merges is None:
            return [self.encode(t or "") for t in column.to_pylist()]
        return encode_all(column, self.merges, self.encode)


class Packer:
    """Packs pieces (document, start, length) of one task; sequences leave as soon as they are full."""

    def __init__(self, tiers: tuple[int, ...], task: int, groups: int) -> None:
        self.tiers, self.top = sorted(tiers, reverse=True), max(tiers)
        self.waiting: dict[int, deque] = {t: deque() for t in self.tiers}
        self.count, self.tokens = 0, dict.fromkeys(self.tiers, 0)  # of what waits
        self.next_id, self.groups = task << 36, groups
        self.dealt = defaultdict(lambda: task * 7919 % groups)  # by tier: the group that gets the next sequence
        self.done: list[tuple] = []

    def wait(self, doc: int, start: int, length: int, first: bool = False) -> None:
        tier = min(t for t in self.tiers if t >= length)
        (self.waiting[tier].appendleft if first else self.waiting[tier].append)((doc, start, length))
        self.count += 1
        self.tokens[tier] += length

    def next(self, tier: int) -> tuple:
        self.count -= 1
        piece = self.waiting[tier].popleft()
        self.tokens[tier] -= piece[2]
        return piece

    def add(self, doc: int, tokens: int) -> None:
        start = 0
        while tokens - start >= self.top:
            self.emit([(doc, start, self.top)], self.top)
            start += self.top
        if tokens > start:
            self.wait(doc, start, tokens - start)

    def emit(self, pieces: list[tuple], tier: int) -> None:
        offset, group = 0, self.dealt[tier]
        for doc, start, length in pieces:
            self.done.append((doc, start, length, self.next_id, offset, tier, group))
            offset += length
        self.next_id += 1
        self.dealt[tier] = (group + 1) % self.groups

    def filler(self, tier: int, room: int) -> int | None:
        """The tier of the next piece for a gap: the longest shorter one that fits, else the shortest one that there is, up to the window's own."""
        below = [t for t in self.tiers if t <= tier and self.waiting[t]]
        return next((t for t in below if t <= room and t < tier), below[-1] if below else None)

    def pack(self, last: bool) -> None:
        """Pack each tier into its windows; but for the last call, stop when too little is left to fill the longest one."""
        for tier in self.tiers:
            while self.waiting[tier] and sum(n for t, n in self.tokens.items() if t <= tier) >= tier:
                if not last and sum(self.tokens.values()) < 2 * self.top:
                    return
                pieces, room, take = [], tier, tier
                while room:
                    doc, start, length = self.next(take)
                    if length > room:  # cut at the gap's end; the rest waits first in its tier
                        self.wait(doc, start + room, length - room, first=True)
                        length = room
                    pieces.append((doc, start, length))
                    room -= length
                    take = self.filler(tier, room)
                self.emit(pieces, tier)
        if last:
            self.in_powers([self.next(t) for t in self.tiers for _ in range(len(self.waiting[t]))])

    def in_powers(self, pieces: list[tuple]) -> None:
        """What fills no window as sequences whose lengths are powers of two."""
        total, queue = sum(p[2] for p in pieces), deque(pieces)
        while total:
            size = room = min(self.top, 1 << (total.bit_length() - 1))
            part = []
            while room:
                doc, start, length = queue.popleft()
                if length > room:
                    queue.appendleft((doc, start + room, length - room))
                    length = room
                part.append((doc, start, length))
                room -= length
            self.emit(part, size)
            total -= size


def step_count(docs: DataFrame, step_tokens: int) -> int:
    """Step groups of about step_tokens tokens for all documents, by their bytes."""
    size = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    return max(1, round(((size[0] or 0) / TOKEN_BYTES + size[1]) / step_tokens))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 20) -> DataFrame:
    """One row for each piece. sequence_id is unique across tasks (the task's number stands in the upper bits); tier is the sequence's length, step_group the group it is dealt to."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("packing")
        encoder = UnitEncoder.of(tokenizer)
        packer = Packer(tiers, TaskContext.get().partitionId(), groups)
        held: dict[int, list] = {}  # number -> [doc_id, ids from some token not beyond the first that waits, that token, all tokens, tokens not yet packed]
        number = 0

        def flush() -> pa.RecordBatch | None:
            rows = []
            for doc, start, length, sequence, offset, tier, step in packer.done:
                entry = held[doc]
                at = 4 * (start - entry[2])
                rows.append((entry[0], start, length, zlib.crc32(memoryview(entry[1])[at : at + 4 * length]), entry[3], sequence, offset, tier, step))
                entry[4] -= length
                if not entry[4]:
                    del held[doc]
            packer.done.clear()
            if not rows:
                return None
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_arrow), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.int32()), pa.array(cols[8], pa.int64())], names)

        for batch in batches:
            first = number
            id_arrow = batch.schema.field("doc_id").type
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text")), strict=True):
                ids += end
                tokens = len(ids) // 4
                held[number] = [doc_id, ids, 0, tokens, tokens]
                packer.add(number, tokens)
                number += 1
            if packer.count > WAITING:
                packer.pack(last=False)
            if (out := flush()) is not None:
                yield out
            for entry in (held[n] for n in range(first, number) if n in held):  # documents are packed from their start; only what waits is kept
                if entry[4] < entry[3]:
                    entry[1:3] = entry[1][-4 * entry[4] :], entry[3] - entry[4]
        packer.pack(last=True)
        if (out := flush()) is not None:
            yield out
        give_back()

    groups = step_count(docs, step_tokens)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return with_text(docs, "doc_id").mapInArrow(run, f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint")
