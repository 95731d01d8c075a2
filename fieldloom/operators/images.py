"""Page preparation and degradation on whole images, as numpy kernels for Arrow UDFs. Images are 2-D uint8 arrays.

Codecs are plug-ins (see sources.documents); these kernels need numpy alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Knobs of the preparation.
BACKGROUND_WIDTH, BACKGROUND_SIGMA = 160, 12.0
SPECK_JUMP, SPECK_SHARE = 40, 0.004
SKEW_WIDTH, SKEW_RANGE, SKEW_STEP = 900, 3.0, 0.25
SMALL_WIDTH, ENLARGE = 1400, 2


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, as float."""
    h, w = image.shape
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    a = image.astype(np.float32)
    return (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian, edges extended."""
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = image.astype(np.float32)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        out = np.apply_along_axis(np.convolve, axis, np.pad(out, pad, mode="edge"), k, mode="valid")
    return out


def rotate(image: np.ndarray, degrees: float, fill: float = 255.0) -> np.ndarray:
    """Counter-clockwise about the centre, bilinear, as float."""
    h, w = image.shape
    t = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(np.float32)
    y, x = y - (h - 1) / 2, x - (w - 1) / 2
    sx, sy = np.cos(t) * x - np.sin(t) * y + (w - 1) / 2, np.sin(t) * x + np.cos(t) * y + (h - 1) / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    padded = np.pad(image.astype(np.float32), 1, constant_values=fill)
    at = lambda yy, xx: padded[np.clip(yy + 1, 0, h + 1), np.clip(xx + 1, 0, w + 1)]
    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


def flatten_light(image: np.ndarray) -> np.ndarray:
    """Divide by the blurred background, so that paper is equally bright all over."""
    h, w = image.shape
    small = resize(image, max(1, h * BACKGROUND_WIDTH // w), BACKGROUND_WIDTH)
    back = np.maximum(resize(blur(small, BACKGROUND_SIGMA), h, w), 1)
    return np.clip(image / back * 255, 0, 255).astype(np.uint8)


def median3(image: np.ndarray) -> np.ndarray:
    p = np.pad(image, 1, mode="edge")
    h, w = image.shape
    return np.median(np.stack([p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)]), axis=0).astype(np.uint8)


def specks(image: np.ndarray, filtered: np.ndarray) -> float:
    return float((np.abs(image.astype(np.int16) - filtered) > SPECK_JUMP).mean())


def remove_specks(image: np.ndarray) -> np.ndarray:
    """The median, if there are enough specks to be worth its blur."""
    filtered = median3(image)
    return filtered if specks(image, filtered) >= SPECK_SHARE else image


def skew(image: np.ndarray) -> float:
    """The angle that makes ink change most from row to row."""
    h, w = image.shape
    small = resize(image, max(1, h * SKEW_WIDTH // w), SKEW_WIDTH) if w > SKEW_WIDTH else image
    angles = np.arange(-SKEW_RANGE, SKEW_RANGE + SKEW_STEP / 2, SKEW_STEP)
    scores = [np.var(np.diff((255 - rotate(small, a)).sum(axis=1))) for a in angles]
    return float(angles[int(np.argmax(scores))])


def straighten(image: np.ndarray) -> np.ndarray:
    angle = skew(image)
    return image if abs(angle) < 1e-6 else np.clip(rotate(image, angle), 0, 255).astype(np.uint8)


def enlarge(image: np.ndarray) -> np.ndarray:
    h, w = image.shape
    return image if w >= SMALL_WIDTH else np.clip(resize(image, h * ENLARGE, w * ENLARGE), 0, 255).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    low, ink = n.cumsum(), (n * np.arange(256)).cumsum()
    high = n.sum() - low
    both = (low > 0) & (high > 0)
    if not both.any():
        return 128
    gap = ink / np.maximum(low, 1) - (ink[-1] - ink) / np.maximum(high, 1)
    return int(np.argmax(np.where(both, low * high * gap**2, -1)))


def binarise(image: np.ndarray) -> np.ndarray:
    return np.where(image > otsu(image), 255, 0).astype(np.uint8)


def prepare(image: np.ndarray) -> np.ndarray:
    """Light, specks, skew, size, black and white, in this order."""
    for step in (flatten_light, remove_specks, straighten, enlarge, binarise):
        image = step(image)
    return image


def degrade(image: np.ndarray, profile: dict, seed: int) -> np.ndarray:
    """A scan of a page: rotation, vignette, blur, noise, specks, brightness and contrast of a profile of schema.PROFILES."""
    rng = np.random.default_rng(seed)
    out = rotate(image, rng.uniform(*profile["rotation"]))
    h, w = out.shape
    y, x = np.mgrid[0:h, 0:w]
    r2 = ((y - h / 2) ** 2 + (x - w / 2) ** 2) / ((h / 2) ** 2 + (w / 2) ** 2)
    out = blur(out * (1 - profile["vignette"] * r2), max(profile["blur"], 1e-3))
    out = out + rng.normal(0, profile["sigma"], out.shape)
    u = rng.random(out.shape)
    out = np.where(u < profile["specks"] / 2, 0, np.where(u < profile["specks"], 255, out))
    out = np.clip(out * rng.uniform(*profile["brightness"]), 0, 255)
    out = (out - out.mean()) * rng.uniform(*profile["contrast"]) + out.mean()
    return np.clip(out, 0, 255).astype(np.uint8)


def map_images(images: DataFrame, step) -> DataFrame:
    """images (img_id, height, width, pixels: binary) with a kernel applied to each."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for img_id, h, w, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out = step(np.frombuffer(raw, np.uint8).reshape(h, w))
                rows.append((img_id, *out.shape, out.tobytes()))
            columns = zip(*rows, strict=True) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, batch.schema.types, strict=True)], names=batch.schema.names)

    kept = images.select("img_id", "height", "width", "pixels")
    return kept.mapInArrow(apply, kept.schema)
