"""Telephony audio columns: companded samples, ADPCM blocks and resampled PCM.

`wave_bytes` stores 8-bit mu-law (or A-law) codes as a WAVE file, `read_wave` gives them back byte for byte;
`expand` turns codes into 16-bit PCM by a 256-entry table; `adpcm_decode` decodes IMA ADPCM blocks with numpy, one step of all
blocks at a time; `upsample` doubles the rate by linear interpolation. Everything is integer arithmetic, so results do not depend on batches.

`text_media` stores each text twice: as a WAVE of companded samples, from which the payload comes back, and as PCM resampled to twice the rate; `media_features` reads both back.

Null texts count as empty. An empty payload is one padding block. Very long texts come a few at a time (slices of SLICE bytes, and their texts whole). Repeated rows give repeated results; empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmill.llm.common import arrow_map, utf8_views, with_text

UNIT = 576
PAD = 255
RATE = 8000
MU_LAW, A_LAW = 7, 6  # WAVE format tags


def mu_law_table() -> np.ndarray:
    """G.711 mu-law: complement, then sign, 3-bit exponent and 4-bit mantissa over a bias of 33 (scaled to 16 bits)."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 1) + 33) << ((code >> 4) & 7)) - 33
    return (np.where(code & 0x80, -size, size) << 2).astype(np.int16)


def a_law_table() -> np.ndarray:
    """G.711 A-law: even bits inverted, then sign, exponent and mantissa; the lowest segment is linear."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


EXPAND = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}

# Fixed values of the IMA ADPCM format: 89 step sizes and the change of the step index by code.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def step_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index and code: the change of the predictor, and the next index."""
    code = np.arange(16)
    step = STEPS[:, None]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    change = np.where(code & 8, -change, change).astype(np.int32)
    index = np.clip(np.arange(len(STEPS))[:, None] + INDEX_CHANGE[code & 7], 0, len(STEPS) - 1).astype(np.int32)
    return change, index


CHANGE, NEXT_INDEX = step_tables()


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """int16 samples [block, sample] of mono IMA ADPCM blocks (uint8 [block, bytes]): a 4-byte header (first sample, step index), then codes, low nibble first."""
    head = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(codes), len(blocks)), np.int16)
    out[0] = head
    at = 1
    for row in codes:
        for code in (row & 15, row >> 4):
            head = np.clip(head + CHANGE[index, code], -32768, 32767)
            index = NEXT_INDEX[index, code]
            out[at] = head
            at += 1
    return out.T


def adpcm_encode(pcm: np.ndarray) -> np.ndarray:
    """uint8 [block, bytes] of int16 samples [block, odd count]: the inverse that adpcm_decode reads."""
    samples = pcm.astype(np.int32)
    head, index = samples[:, 0].copy(), np.zeros(len(pcm), np.int32)
    codes = np.empty((len(pcm), samples.shape[1] - 1), np.uint8)
    for i in range(1, samples.shape[1]):
        step, diff = STEPS[index], samples[:, i] - head
        code, left = np.where(diff < 0, 8, 0), np.abs(diff)
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = left >= part
            code, left = code + bit * hit, left - part * hit
        head = np.clip(head + CHANGE[index, code], -32768, 32767)
        index = NEXT_INDEX[index, code]
        codes[:, i - 1] = code
    out = np.zeros((len(pcm), 4 + codes.shape[1] // 2), np.uint8)
    out[:, :2] = pcm[:, :1].astype("<i2").view(np.uint8)
    out[:, 4:] = codes[:, 0::2] | (codes[:, 1::2] << 4)
    return out


def wave_bytes(codes: bytes, law: int = MU_LAW, rate: int = RATE) -> bytes:
    """A mono WAVE file of 8-bit companded samples: fmt, fact and data chunks."""
    fmt = struct.pack("<4sIHHIIHHH", b"fmt ", 18, law, 1, rate, rate, 1, 8, 0)
    fact = struct.pack("<4sII", b"fact", 4, len(codes))
    data = struct.pack("<4sI", b"data", len(codes)) + codes + b"\0" * (len(codes) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(fact) + len(data), b"WAVE") + fmt + fact + data


def read_wave(wave: bytes) -> tuple[int, bytes]:
    """(format tag, sample bytes) of a WAVE file; ValueError if it isn't one."""
    if wave[:4] != b"RIFF" or wave[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, law = 12, None
    while at + 8 <= len(wave):
        name, size = wave[at : at + 4], struct.unpack_from("<I", wave, at + 4)[0]
        if name == b"fmt ":
            law = struct.unpack_from("<H", wave, at + 8)[0]
        elif name == b"data":
            if law is None or at + 8 + size > len(wave):
                break
            return law, wave[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no whole data chunk")


def upsample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: every second sample lies halfway (rounded down) to the next one; the last is held."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
    out[-1:] = pcm[-1:]
    return out


def text_payload(text: bytes) -> bytes:
    """The text's bytes, filled up to a positive multiple of the unit."""
    return text + bytes([PAD]) * (UNIT * max(1, -(-len(text) // UNIT)) - len(text))


def resampled_bytes(law: int, codes: bytes) -> bytes:
    """Little-endian 16-bit samples at twice the stored rate."""
    return upsample(EXPAND[law][np.frombuffer(codes, np.uint8)]).astype("<i2").tobytes()


def pcm_feature(law: int, codes: bytes, doubled: bytes) -> str:
    """Energy, peak and zero crossings of the expanded samples, and a checksum of the resampled PCM, as a string."""
    pcm = EXPAND[law][np.frombuffer(codes, np.uint8)]
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"n={len(pcm)};e={int(wide @ wide)};p={int(np.abs(wide).max())};z={crossings};r={zlib.crc32(doubled):08x}"


#: ADPCM blocks decoded at a time; bytes of a slice of a batch.
BLOCKS, SLICE = 4096, 1 << 20


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, wave, pcm_rate and pcm: each text's payload as a mu-law WAVE file, and its resampled PCM."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        payloads, sizes = [], []
        for text in utf8_views(batch.column("text")):
            sizes.append(len(text))
            payloads.append(text_payload(text))
        pcm = [resampled_bytes(MU_LAW, p) for p in payloads]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(map(wave_bytes, payloads), pa.binary()), pa.array([2 * RATE] * len(pcm), pa.int32()), pa.array(pcm, pa.binary())], ["doc_id", "n_bytes", "wave", "pcm_rate", "pcm"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(with_text(docs, "doc_id"), f"doc_id {id_type}, n_bytes bigint, wave binary, pcm_rate int, pcm binary", work, most=SLICE)


def media_features(media: DataFrame) -> DataFrame:
    """What reading the stored waves back gives: digests of payload and stored form, and features of the samples.

    The payload is also read as ADPCM blocks of one unit each; their decoded energy is part of the feature."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        waves, doubled = batch.column("wave").to_pylist(), batch.column("pcm").to_pylist()
        read = [read_wave(w) for w in waves]
        sizes = [len(codes) // UNIT for _, codes in read]
        blocks = np.frombuffer(b"".join(codes for _, codes in read), np.uint8).reshape(-1, UNIT)
        energy = np.concatenate([(np.abs(adpcm_decode(blocks[i : i + BLOCKS]).astype(np.int64))).sum(1) for i in range(0, len(blocks), BLOCKS)])
        ends = np.cumsum(sizes)
        rows = []
        for (law, codes), wave, pcm, end, size in zip(read, waves, doubled, ends, sizes, strict=True):
            feature = f"{pcm_feature(law, codes, pcm)};a={int(energy[end - size : end].sum())}"
            rows.append((len(codes), hashlib.sha256(codes).hexdigest(), zlib.crc32(codes[-32:]), len(wave), hashlib.sha256(wave).hexdigest(), feature, len(pcm)))
        cols = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes"])

    id_type = media.schema["doc_id"].dataType.simpleString()
    return arrow_map(media, f"doc_id {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pcm_bytes bigint", work, most=4 * SLICE)


def resampled(media: DataFrame) -> DataFrame:
    """doc_id, rate and pcm: little-endian 16-bit samples at twice the stored rate."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pcm = [resampled_bytes(law, codes) for law, codes in map(read_wave, batch.column("wave").to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([2 * RATE] * len(pcm), pa.int32()), pa.array(pcm, pa.binary())], ["doc_id", "rate", "pcm"])

    id_type = media.schema["doc_id"].dataType.simpleString()
    return arrow_map(media, f"doc_id {id_type}, rate int, pcm binary", work)
