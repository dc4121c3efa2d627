"""Language identification with a string kernel.

Kernel: blended-spectrum presence. A text is the set of its byte n-grams (n = 1 to 4, A-Z lower-cased, white space as one blank, a blank at both ends), hashed to DIM
cells; k(x, y) = |X and Y| / sqrt(|X| |Y|). Nystroem: m landmark texts give K_mm; phi(x) = K_mm^(-1/2) k_m(x). One-versus-rest ridge
regression on phi gives one weight vector for each language. As k_m(x) = L x / |x| with L the (normalized) landmark rows, the scores of
a batch X of texts are X (L' K_mm^(-1/2) W): the right factor is made once (DIM x languages), and a batch is one matrix product.

Training rows: language not null, text with a letter, accepted by the caller's predicate. Of each language PER_LANGUAGE distinct ids of such rows are taken by their hash (fewer of
each where there are over LANGUAGES languages; no language is left out), a bounded sample; everything else reads all rows and whole texts. A worker sends back one bit
set of DIM cells for each sampled text.

Predictions use the text alone. Null texts and texts without a letter are `und` with score 0, as is everything if there is nothing to learn from. Ties go to the language
that sorts first. Repeated rows get equal results; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import arrow_map, with_text

DIM = 1 << 15
LANGUAGES, PER_LANGUAGE, LANDMARKS = 64, 300, 400
RIDGE = 1e-2
UNKNOWN = "und"
#: A prediction below this score is none: words of a few letters that several languages share.
LEAST_SCORE = 0.25
#: Odd multipliers that spread the n-grams of each length over the cells.
MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)
#: Texts scored in one product.
ROWS = 256
_space = re.compile(rb"[\x20\x09-\x0D]+")


def cells(text: bytes) -> np.ndarray:
    """Sorted distinct cells of the text's n-grams."""
    raw = np.frombuffer(b" " + _space.sub(b" ", text).strip().lower() + b" ", np.uint8)
    seen = np.zeros(DIM, bool)
    for at in range(0, len(raw), 1 << 20):  # very long texts in parts that overlap by three bytes
        part = raw[at : at + (1 << 20) + 3].astype(np.uint32)
        gram = part
        for n, multiplier in enumerate(MULTIPLIERS):
            if n:
                if len(part) <= n:
                    break
                gram = gram[:-1] | (part[n:] << np.uint32(8 * n))
            seen[(gram * np.uint32(multiplier)) >> np.uint32(17)] = True
    return np.flatnonzero(seen)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # DIM x languages

    def scores(self, texts: list[str]) -> np.ndarray:
        """Texts x languages, clipped to [0, 1]."""
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(texts), ROWS):
            part = texts[at : at + ROWS]
            x = np.zeros((len(part), DIM), np.float32)
            for row, text in zip(x, part, strict=True):
                own = cells(text.encode("utf-8"))
                row[own] = 1 / np.sqrt(len(own))
            out[at : at + ROWS] = x @ self.weights
        return np.clip(out, 0, 1)


def kernel(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """k of every text (packed presence rows) with every landmark (normalized float32 rows), in blocks of ROWS texts."""
    out = np.empty((len(bits), len(marks)))
    for at in range(0, len(bits), ROWS):
        x = np.unpackbits(bits[at : at + ROWS], axis=1).astype(np.float32)
        out[at : at + ROWS] = (x @ marks.T) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    return out


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """bits: texts x DIM / 8 bytes, presence packed as by numpy. Landmarks are dealt evenly over the rows; only they are ever unpacked together."""
    languages = tuple(sorted(set(labels)))
    chosen = np.unique(np.linspace(0, len(bits) - 1, min(landmarks, len(bits))).astype(int))
    marks = np.unpackbits(bits[chosen], axis=1).astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
    k = kernel(bits, marks)
    values, vectors = np.linalg.eigh(k[chosen])
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # K_mm^(-1/2), up to a rotation
    phi = k @ root
    target = np.array([[float(label == lang) for lang in languages] for label in labels])
    balance = 1 / (target @ target.sum(0))[:, None]  # every language weighs the same
    solved = np.linalg.solve(phi.T @ (phi * balance) + ridge * np.eye(phi.shape[1]) / len(bits), phi.T @ (target * balance))
    return Model(languages, marks.T @ (root @ solved).astype(np.float32))


def train(docs: DataFrame, usable: Column) -> Model | None:
    """A model from the rows that `usable` accepts; None if there are none."""
    learnable = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keys = learnable.select("doc_id", "lang")
    counts = [(r[0], max(1, r[1])) for r in keys.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()]
    if not counts:
        return None
    per = max(1, min(PER_LANGUAGE, LANGUAGES * PER_LANGUAGE // len(counts)))
    spread = F.xxhash64(F.lit("langid"), "doc_id")
    # about twice the rows that are kept pass a threshold on the hash, so that few rows of a language meet in the task that ranks them
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, max(2 * per, per + 40) / n))])[F.col("lang")]
    near = keys.filter(F.pmod(spread, F.lit(1 << 30)) < share * (1 << 30)).distinct()
    order = W.partitionBy("lang").orderBy(spread, "doc_id")
    # at most LANGUAGES * PER_LANGUAGE ids (or one for each language), so small enough to broadcast
    chosen = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per).select("doc_id", "lang")
    rows = learnable.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        bits = []
        for text in texts:
            flags = np.zeros(DIM, bool)
            if has_letter(text):
                flags[cells(text.encode("utf-8"))] = True
            bits.append(np.packbits(flags).tobytes())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(bits, pa.binary())], ["doc_id", "lang", "bits"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    # repeated ids: one row each, so that the sample stays bounded
    sets = arrow_map(rows, f"doc_id {id_type}, lang string, bits binary", work).groupBy("doc_id", "lang").agg(F.min("bits").alias("bits")).collect()
    sets = sorted((r for r in sets if any(r["bits"])), key=lambda r: (r["lang"], str(r["doc_id"])))
    if not sets:
        return None
    bits = np.frombuffer(b"".join(r["bits"] for r in sets), np.uint8).reshape(len(sets), -1)
    return fit(bits, [r["lang"] for r in sets])


def predict(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """The kept columns, lang_pred and score."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
        if known:
            found = model.scores([texts[i] for i in known])
            for i, best, value in zip(known, found.argmax(1), found.max(1), strict=True):
                label[i], score[i] = model.languages[best], value
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(label, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_map(with_text(docs, *keep), f"{types}, lang_pred string, score double", work)


def fold() -> Column:
    """crc32 of the document's id, modulo 4; fold 2 is never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; a null doc_id is held out."""
    held = F.coalesce(fold() == 2, F.lit(True))
    model = train(docs, ~held)
    return predict(docs.select("doc_id", "text"), model, "doc_id").select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, languages: tuple[str, ...] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """docs whose predicted language is one of `languages` (None: any learned one) with a score of at least `least`; texts that are null or have no letter go, too. Without a
    model (nothing to learn from) every text with a letter stays.

    The prediction runs beside the other columns in one pass, so nothing is joined."""
    model = train(docs, ~F.coalesce(fold() == 2, F.lit(True)))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = batch.column("text").to_pylist()
        keep = np.array([has_letter(t) for t in texts])
        known = np.flatnonzero(keep)
        if model and len(known):
            found = model.scores([texts[i] for i in known])
            wanted = np.array([languages is None or lang in languages for lang in model.languages])
            keep[known] = wanted[found.argmax(1)] & (found.max(1) >= least)
        return batch.filter(pa.array(keep)) if keep.any() else None

    return arrow_map(docs, docs.schema, work)
