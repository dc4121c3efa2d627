"""Numeric image kernels against plain loops."""

import numpy as np
import pytest

from glyphmill.operators import images


@pytest.fixture
def img():
    return np.random.default_rng(2).integers(0, 256, (13, 21)).astype(np.uint8)


def test_area_resize_is_the_mean_of_what_a_pixel_covers(img):
    assert (images.resized(img, 13, 21) == img).all()
    half = images.resized(img[:12, :20], 6, 10)
    assert (half == np.rint(img[:12, :20].reshape(6, 2, 10, 2).mean((1, 3)))).all()
    colour = np.stack([img, img, 255 - img], axis=2)
    assert (images.resized(colour, 5, 7)[:, :, 0] == images.resized(img, 5, 7)).all()
    crop = images.equation_crop(img)
    assert crop.shape == (384, 384, 3) and (crop[0] == 255).all()
    assert images.height_normalized(img).shape == (64, 103)


def test_margins(img):
    out, ratio, (left, top) = images.letterboxed(img, target=64, stride=32)
    assert out.shape[0] % 32 == 0 and out.shape[1] % 32 == 0 and ratio == 64 / 21 and (out[:top] == 114).all() and left == 0
    padded = images.stride_padded(img)
    assert padded.shape == (32, 32) and (padded[:13, :21] == img).all() and (padded[13:] == 114).all()


def test_blur_and_thresholds(img):
    flat = np.full((9, 9), 77, np.uint8)
    assert np.allclose(images.gaussian(flat, 5), 77) and (images.adaptive_threshold(flat) == 255).all()
    size = 5
    x = np.arange(size) - 2
    w = np.exp(-(x * x) / (2 * 1.1**2))
    w = np.outer(w, w) / np.outer(w, w).sum()
    edge = np.pad(img.astype(float), 2, mode="edge")
    plain = np.array([[(edge[i : i + 5, j : j + 5] * w).sum() for j in range(21)] for i in range(13)])
    assert np.allclose(images.gaussian(img, 5, "edge"), plain)
    assert (images.adaptive_threshold(img, 5, 3) == np.where(img > np.rint(plain) - 3, 255, 0)).all()
    middle = np.pad(img, 1, mode="edge")
    assert (images.denoised(img, "median") == [[np.median(middle[i : i + 3, j : j + 3]) for j in range(21)] for i in range(13)]).all()
    assert images.denoised(img, "unknown") is img and images.denoised(flat, "gaussian").tolist() == flat.tolist()
    noisy = images.with_noise(img, 0.1, 5)
    assert noisy.dtype == np.uint8 and (noisy == images.with_noise(img, 0.1, 5)).all() and (noisy != img).any()
