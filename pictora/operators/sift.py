"""Scale-invariant local descriptors (Lowe 2004), in numpy, over images the JVM decodes.

Extrema of differences of Gaussians over scale and place, dropped where contrast is low or the point lies on an edge;
orientations from gradient histograms; descriptors of 4 x 4 cells with 8 directions each, normalised, clipped at 0.2 and
normalised again. Any function of the same signature can stand in for ``extract``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "image_id string, scale double, orientation double, x double, y double, descriptor array<double>"
PER_OCTAVE, SIGMA, CONTRAST, EDGE, PEAK = 3, 1.6, 0.03, 10.0, 0.8


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Brightness from 0 to 1 of a decoded image (blue, green, red order)."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return (a[..., 0] if channels == 1 else a[..., :3] @ np.array([0.114, 0.587, 0.299])) / 255


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        padded = np.pad(image, pad, "edge")
        image = sum(w * np.take(padded, range(i, i + image.shape[axis]), axis) for i, w in enumerate(k))
    return image


def _pyramid(image: np.ndarray) -> Iterator[list[np.ndarray]]:
    step = 2 ** (1 / PER_OCTAVE)
    base = blur(image, np.sqrt(max(SIGMA**2 - 0.25, 0.01)))
    while min(base.shape) >= 16:
        levels = [base]
        for k in range(1, PER_OCTAVE + 3):
            levels.append(blur(levels[-1], SIGMA * step ** (k - 1) * np.sqrt(step**2 - 1)))
        yield levels
        base = levels[PER_OCTAVE][::2, ::2]


def _extrema(levels: list[np.ndarray]) -> list[tuple[int, int, int]]:
    d = np.stack([b - a for a, b in zip(levels, levels[1:])])
    core = d[1:-1, 1:-1, 1:-1]
    around = np.stack([d[1 + s : d.shape[0] - 1 + s, 1 + y : d.shape[1] - 1 + y, 1 + x : d.shape[2] - 1 + x] for s in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (s, y, x) != (0, 0, 0)])
    found = ((core > around.max(axis=0)) | (core < around.min(axis=0))) & (np.abs(core) > CONTRAST / PER_OCTAVE)
    out = []
    for s, y, x in np.argwhere(found) + 1:
        p = d[s]
        xx, yy = p[y, x + 1] + p[y, x - 1] - 2 * p[y, x], p[y + 1, x] + p[y - 1, x] - 2 * p[y, x]
        xy = (p[y + 1, x + 1] + p[y - 1, x - 1] - p[y + 1, x - 1] - p[y - 1, x + 1]) / 4
        if (det := xx * yy - xy * xy) > 0 and (xx + yy) ** 2 / det < (EDGE + 1) ** 2 / EDGE:
            out.append((int(s), int(y), int(x)))
    return out


def _patch(size: np.ndarray, angle: np.ndarray, y: int, x: int, r: int) -> tuple[np.ndarray, ...]:
    ys, xs = np.mgrid[max(y - r, 0) : min(y + r + 1, size.shape[0]), max(x - r, 0) : min(x + r + 1, size.shape[1])]
    return ys - y, xs - x, size[ys, xs], angle[ys, xs]


def _orientations(size: np.ndarray, angle: np.ndarray, y: int, x: int, sigma: float) -> list[float]:
    dy, dx, m, a = _patch(size, angle, y, x, int(round(4.5 * sigma)))
    w = m * np.exp(-(dx * dx + dy * dy) / (2 * (1.5 * sigma) ** 2))
    h = np.bincount((np.round(a * 36 / (2 * np.pi)).astype(int) % 36).ravel(), w.ravel(), 36)
    h = (np.roll(h, 1) + 2 * h + np.roll(h, -1)) / 4
    peaks = np.flatnonzero((h > np.roll(h, 1)) & (h > np.roll(h, -1)) & (h >= PEAK * h.max()) & (h > 0))
    return [float(p * 2 * np.pi / 36) for p in peaks]


def _descriptor(size: np.ndarray, angle: np.ndarray, y: int, x: int, sigma: float, turn: float) -> np.ndarray:
    cell = 3 * sigma
    dy, dx, m, a = _patch(size, angle, y, x, int(round(cell * 3.6)))
    c, s = np.cos(turn), np.sin(turn)
    u, v = (c * dx + s * dy) / cell, (-s * dx + c * dy) / cell
    w = m * np.exp(-(u * u + v * v) / 8)
    bu, bv, bo = u + 1.5, v + 1.5, ((a - turn) % (2 * np.pi)) * 8 / (2 * np.pi)
    out = np.zeros((4, 4, 8))
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                pu, pv, po = np.floor(bu) + i, np.floor(bv) + j, np.floor(bo) + k
                share = w * (1 - np.abs(bu - pu)) * (1 - np.abs(bv - pv)) * (1 - np.abs(bo - po))
                ok = (pu >= 0) & (pu < 4) & (pv >= 0) & (pv < 4)
                np.add.at(out, (pv[ok].astype(int), pu[ok].astype(int), po[ok].astype(int) % 8), share[ok])
    out = out.ravel()
    for most in (0.2, np.inf):
        n = np.linalg.norm(out)
        out = np.minimum(out / n if n else out, most)
    return out


def extract(image: np.ndarray) -> list[tuple[float, float, float, float, list[float]]]:
    """(scale, orientation, x, y, 128 values) of each point of interest."""
    out = []
    for octave, levels in enumerate(_pyramid(image)):
        gradients = {}
        for s, y, x in _extrema(levels):
            sigma = SIGMA * 2 ** (s / PER_OCTAVE)
            if s not in gradients:
                gy, gx = np.gradient(levels[s])
                gradients[s] = np.hypot(gx, gy), np.arctan2(gy, gx) % (2 * np.pi)
            for turn in _orientations(*gradients[s], y, x, sigma):
                out.append((sigma * 2**octave, turn, float(x * 2**octave), float(y * 2**octave), _descriptor(*gradients[s], y, x, sigma, turn).tolist()))
    return out


def extract_features(images: DataFrame, extractor: Callable[[np.ndarray], list] = extract) -> DataFrame:
    """Descriptors of ``(image_key, height, width, n_channels, data)``; images without any have no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.image_key, *p) for r in frame.itertuples() for p in extractor(gray(r.data, r.height, r.width, r.n_channels))]
            yield pd.DataFrame(rows, columns=["image_id", "scale", "orientation", "x", "y", "descriptor"])

    return images.mapInPandas(run, SCHEMA)
