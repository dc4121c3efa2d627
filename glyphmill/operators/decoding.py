"""Decoding of score tensors: CTC prefix scores, beam search, several passes. One sample is one row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def log_softmax(x: np.ndarray) -> np.ndarray:
    top = x.max(-1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(-1, keepdims=True))


def ctc_prefix_score(log_probs: np.ndarray, prefix: list[int], blank: int = 0) -> float:
    """Log probability that an output starts with the prefix: forward variables over time, ending in the prefix's last symbol (n) or a blank after it (b)."""
    steps = len(log_probs)
    n = np.full(steps + 1, -np.inf)
    b = np.concatenate(([0.0], np.cumsum(log_probs[:, blank])))
    if not prefix:
        return 0.0
    last = None
    for symbol in prefix:
        fresh = b if symbol == last else np.logaddexp(n, b)  # before this symbol; a repeated one needs a blank between
        new_n, new_b, start = np.full(steps + 1, -np.inf), np.full(steps + 1, -np.inf), -np.inf
        for t in range(1, steps + 1):
            entered = fresh[t - 1] + log_probs[t - 1, symbol]
            start = np.logaddexp(start, entered)
            new_n[t] = np.logaddexp(new_n[t - 1] + log_probs[t - 1, symbol], entered)
            new_b[t] = np.logaddexp(new_b[t - 1], new_n[t - 1]) + log_probs[t - 1, blank]
        n, b, last = new_n, new_b, symbol
    return float(start)


def beam_search(steps: np.ndarray, width: int, end: int, ctc: np.ndarray | None = None, weight: float = 0.3) -> list[tuple[list[int], float]]:
    """The best sequences with their scores: 2 * width symbols of each step extend each beam, then the best `width` stay; with CTC log probabilities the scores are mixed."""
    scores = log_softmax(np.asarray(steps, np.float64))
    beams: list[tuple[list[int], float, bool]] = [([], 0.0, False)]
    for row in scores:
        order = np.lexsort((np.arange(len(row)), -row))[: 2 * width]
        found = []
        for sequence, score, done in beams:
            if done:
                found.append((sequence, score, True))
                continue
            found += [(sequence if s == end else [*sequence, int(s)], score + float(row[s]), s == end) for s in order]

        def rank(x: tuple[list[int], float, bool]) -> float:
            if ctc is None or not x[0]:
                return x[1]
            return (1 - weight) * x[1] + weight * ctc_prefix_score(ctc, x[0])

        beams = sorted(found, key=rank, reverse=True)[:width]
    return [(s, v) for s, v, _ in beams]


def passes(steps: np.ndarray, width: int, end: int, temperatures: tuple[float, ...] = (0.7, 1.0, 1.3), ctc: np.ndarray | None = None, weight: float = 0.3, score_of: Callable[[list[int]], float] | None = None) -> tuple[list[int], float, float]:
    """(sequence, score, agreement): the best over several temperatures, and 1 / different sequences among the best three."""
    pooled = [b for t in temperatures for b in beam_search(np.asarray(steps) / t, width, end, ctc, weight)]
    if score_of is not None:
        pooled = [(s, (v + score_of(s)) / 2) for s, v in pooled]
    pooled.sort(key=lambda x: -x[1])
    best = pooled[0]
    return best[0], best[1], 1.0 / len({tuple(s) for s, _ in pooled[:3]})


def decode(df: DataFrame, key: str, logits: str = "logits", width: int = 4, end: int = 0, ctc: str | None = None, weight: float = 0.3, score_of: Callable[[list[int]], float] | None = None) -> DataFrame:
    """(key, sequence, score, agreement) of rows with an array of steps of logits; empty ones give empty sequences.

    ctc: a column of frames of logits (the first symbol is the blank) whose prefix scores are mixed in by weight. score_of: an outside score of a sequence, averaged with the decoder's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = batch.column(ctc).to_pylist() if ctc else [None] * batch.num_rows
            rows = [passes(np.array(v, np.float64), width, end, ctc=log_softmax(np.array(c, np.float64)) if c else None, weight=weight, score_of=score_of) if v else ([], 0.0, 1.0) for v, c in zip(batch.column(logits).to_pylist(), frames, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())], [key, "sequence", "score", "agreement"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, logits, *([ctc] if ctc else [])).mapInArrow(run, f"`{key}` {kind}, sequence array<int>, score double, agreement double")
