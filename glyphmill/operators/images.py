"""Numeric image kernels on grey bytes, in numpy over Arrow batches: one picture is one row, so nothing grows beyond a picture."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma of BGR bytes (or the grey ones themselves), uint8."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return raw[:, :, 0]
    return np.round(raw[:, :, :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def moving_average(v: np.ndarray, k: int) -> np.ndarray:
    """Centred, with zeros beyond the ends."""
    return np.convolve(v, np.ones(k) / k, mode="same")


def dark(img: np.ndarray) -> np.ndarray:
    """1 where a pixel is darker than the mean."""
    return (img < img.mean()).astype(np.uint8) if img.std() > 0 else np.zeros_like(img)


def projection(mask: np.ndarray) -> np.ndarray:
    return mask.sum(1).astype(np.float64)


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def baselines(profile: np.ndarray, gap: int = 20, k: int = 5) -> list[int]:
    """Centres of the runs above mean + half a deviation, at least `gap` after the last one accepted; a run that does not end is dropped."""
    smooth = moving_average(profile, k)
    out: list[int] = []
    for a, b in runs(smooth > smooth.mean() + 0.5 * smooth.std()):
        if b < len(smooth) and (not out or (a + b) // 2 - out[-1] >= gap):
            out.append((a + b) // 2)
    return out


def segments(profile: np.ndarray, pad: int = 5, least: int = 10, k: int = 3) -> list[tuple[int, int]]:
    """Ranges of rows above 0.3 of the mean, padded; the last open one stays whatever its height."""
    smooth = moving_average(profile, k)
    out = []
    for a, b in runs(smooth > 0.3 * smooth.mean()):
        if b == len(smooth) or b - a > least:
            out.append((max(0, a - pad), min(len(smooth), b + pad)))
    return out


def count_lines(profile: np.ndarray) -> int:
    """Rising edges above a tenth of the largest value; at least 1."""
    high = profile > 0.1 * profile.max() if len(profile) and profile.max() > 0 else np.zeros(len(profile), bool)
    return max(1, int(np.count_nonzero(high[1:] & ~high[:-1])))


def crop_lines(profile: np.ndarray, gap: int = 10, pad: int = 5) -> list[tuple[int, int]]:
    """Ranges of rows above a tenth of the largest value; gaps of up to `gap` rows don't end one."""
    rows = np.flatnonzero(profile > profile.max() * 0.1) if len(profile) else np.zeros(0, int)
    if not len(rows):
        return []
    parts = np.split(rows, np.flatnonzero(np.diff(rows) > gap) + 1)
    return [(max(0, int(p[0]) - pad), min(len(profile), int(p[-1]) + pad)) for p in parts]


def laplacian_variance(img: np.ndarray) -> float:
    p = np.pad(img.astype(np.float64), 1, mode="reflect") if min(img.shape) > 1 else np.pad(img.astype(np.float64), 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def normalized(img: np.ndarray, mean=(0.485, 0.456, 0.406), std=(0.229, 0.224, 0.225)) -> np.ndarray:
    """float32 channels as the usual image models take them."""
    rgb = np.repeat(img[:, :, None], 3, axis=2) if img.ndim == 2 else img
    return ((rgb / 255.0 - np.array(mean)) / np.array(std)).astype(np.float32)


def padded_square(img: np.ndarray, fill: int = 255) -> np.ndarray:
    side = max(img.shape[:2])
    out = np.full((side, side, *img.shape[2:]), fill, img.dtype)
    y, x = (side - img.shape[0]) // 2, (side - img.shape[1]) // 2
    out[y : y + img.shape[0], x : x + img.shape[1]] = img
    return out


def overlaps(size: int, target: int) -> np.ndarray:
    """target x size: the share of each old pixel in each new one, rows summing to 1 (area interpolation)."""
    edges = np.linspace(0, size, target + 1)
    part = np.minimum(edges[1:, None], np.arange(1, size + 1)) - np.maximum(edges[:-1, None], np.arange(size))
    part = np.clip(part, 0, None)
    return part / part.sum(1, keepdims=True)


def resized(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """By area, rounded; grey or with channels."""
    out = np.einsum("ah,hw...->aw...", overlaps(img.shape[0], height), img.astype(np.float64))
    return np.clip(np.rint(np.einsum("bw,aw...->ab...", overlaps(img.shape[1], width), out)), 0, 255).astype(np.uint8)


def equation_crop(img: np.ndarray, side: int = 384) -> np.ndarray:
    """Three channels on a white square, resized to the model's input."""
    return resized(padded_square(np.repeat(img[:, :, None], 3, axis=2) if img.ndim == 2 else img), side, side)


def height_normalized(img: np.ndarray, height: int = 64) -> np.ndarray:
    """Resized to a height, in proportion."""
    return resized(img, height, max(1, round(img.shape[1] * height / img.shape[0])))


def letterboxed(img: np.ndarray, target: int = 640, stride: int = 32, fill: int = 114) -> tuple[np.ndarray, float, tuple[int, int]]:
    """(picture, ratio, (left, top)): resized to fit the square, with margins up to the next multiple of the stride."""
    ratio = min(target / img.shape[0], target / img.shape[1])
    h, w = round(img.shape[0] * ratio), round(img.shape[1] * ratio)
    dh, dw = (target - h) % stride / 2, (target - w) % stride / 2
    top, left = round(dh - 0.1), round(dw - 0.1)
    out = np.full((h + round(dh + 0.1) + top, w + round(dw + 0.1) + left, *img.shape[2:]), fill, np.uint8)
    out[top : top + h, left : left + w] = resized(img, h, w)
    return out, ratio, (left, top)


def stride_padded(img: np.ndarray, stride: int = 32, fill: int = 114) -> np.ndarray:
    """With margins to the right and below."""
    grown = [(0, -n % stride) for n in img.shape[:2]] + [(0, 0)] * (img.ndim - 2)
    return np.pad(img, grown, constant_values=fill)


def gaussian(img: np.ndarray, size: int = 3, mode: str = "reflect") -> np.ndarray:
    """Blurred by a window of `size`, whose deviation follows from it, as floats."""
    x = np.arange(size) - (size - 1) / 2
    weights = np.exp(-(x * x) / (2 * (0.3 * ((size - 1) * 0.5 - 1) + 0.8) ** 2))
    weights /= weights.sum()
    out = np.pad(img.astype(np.float64), size // 2, mode=mode if min(img.shape) > size // 2 else "edge")
    out = sum(w * out[i : i + img.shape[0]] for i, w in enumerate(weights))
    return sum(w * out[:, i : i + img.shape[1]] for i, w in enumerate(weights))


def adaptive_threshold(img: np.ndarray, size: int = 11, less: float = 2) -> np.ndarray:
    """255 where a grey pixel is above the blurred picture less a constant, else 0."""
    return np.where(img > np.rint(gaussian(img, size, "edge")) - less, 255, 0).astype(np.uint8)


def median_filtered(img: np.ndarray, size: int = 3) -> np.ndarray:
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(img, size // 2, mode="edge"), (size, size))
    return np.median(windows, axis=(2, 3)).astype(np.uint8)


#: Denoising by name; a method that isn't known leaves the picture as it is (bilateral and non-local means belong to image libraries).
DENOISE = {"median": median_filtered, "gaussian": lambda img: np.rint(gaussian(img, 5)).astype(np.uint8)}


def denoised(img: np.ndarray, method: str = "median") -> np.ndarray:
    return DENOISE.get(method, lambda x: x)(img)


def with_noise(img: np.ndarray, intensity: float, seed: int) -> np.ndarray:
    return np.clip(img + np.random.default_rng(seed).normal(0, 255 * intensity, img.shape), 0, 255).astype(np.uint8)


FEATURES = ("blur", "mean", "contrast", "text_density", "line_count", "blank", "arithmetic", "profile")


def features(images: DataFrame, key: str = "origin") -> DataFrame:
    """(key, blur, mean, contrast, text_density, line_count, blank, arithmetic, profile) of rows with height, width, channels, data; nulls where a picture is unreadable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, w, c, data in zip(*(batch.column(n).to_pylist() for n in ("height", "width", "channels", "data")), strict=True):
                if not data or h is None or h <= 0:
                    rows.append((None,) * 8)
                    continue
                img = grey(data, h, w, c)
                mask = dark(img)
                density, lines, contrast, blur = float(mask.mean()), count_lines(projection(mask)), float(img.std()), laplacian_variance(img)
                rows.append((blur, float(img.mean()), contrast, density, lines, contrast < 10 or density < 0.005, lines <= 5 and density < 0.15, "degraded" if blur < 80 or contrast < 40 else "clean"))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.float64()] * 4 + [pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(v, t) for v, t in zip(cols, types, strict=True))], [key, *FEATURES])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "height", "width", "channels", "data").mapInArrow(run, f"`{key}` {kind}, blur double, mean double, contrast double, text_density double, line_count int, blank boolean, arithmetic boolean, profile string")
