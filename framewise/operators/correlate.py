"""Shifts between patches by phase correlation: whole batches of patches go through one two-dimensional Fourier transform, a row in, a row out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# What the transform leaves out as noise, and how it fades out fine detail (in cycles a patch, of its size).
GATE, CUTOFF, FLAT = 1e-4, 0.45, 1e-7


def frequencies(size: int) -> np.ndarray:
    """Signed frequency of each place of a transform; the middle one counts as positive."""
    f = np.arange(size)
    return np.where(f > size // 2, f - size, f)


def window(size: int) -> np.ndarray:
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    return np.outer(w, w)


def correlate(a: np.ndarray, b: np.ndarray, span: float = 0.6, step: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dx, dy, peak, usable) of stacks of square patches: b moved by (dx, dy) looks like a; to `step` of a pixel, within `span` of the best whole pixel.

    Patches are taken about their means through a Hann window; every frequency that both have counts alike but for a fading of fine ones."""
    m, n = len(a), a.shape[1]
    w = window(n)
    a, b = ((p - p.mean(axis=(1, 2), keepdims=True)) * w for p in (a, b))
    usable = (np.sqrt((a * a).mean(axis=(1, 2))) >= FLAT) & (np.sqrt((b * b).mean(axis=(1, 2))) >= FLAT)
    fa, fb = np.fft.fft2(a), np.fft.fft2(b)
    size = np.abs(fa) * np.abs(fb)
    cross = fa * np.conj(fb)
    keep = (size > size.max(axis=(1, 2), keepdims=True) * GATE) & (np.abs(cross) > 1e-20)
    f = frequencies(n)
    fade = np.exp(-(f[:, None] ** 2 + f[None, :] ** 2) / (CUTOFF * n) ** 2)
    power = np.where(keep, cross * fade / np.where(keep, np.abs(cross), 1), 0)
    surface = np.fft.ifft2(power).real
    at = surface.reshape(m, -1).argmax(axis=1)
    iy, ix = at // n, at % n
    signed = np.where(np.arange(n) >= n // 2, np.arange(n) - n, np.arange(n))
    offsets = -span + np.arange(round(2 * span / step) + 1) * step
    # The surface between pixels: the same sums at finer places, along x and then along y.
    along = lambda whole: np.exp(2j * np.pi * signed[None, :, None] * (whole[:, None, None] + offsets[None, None, :]) / n)
    fine = np.matmul(np.swapaxes(along(iy), 1, 2), np.matmul(power, along(ix))).real
    best = fine.reshape(m, -1).argmax(axis=1)
    wrap = lambda k: np.where(k > n // 2, k - n, k)
    return wrap(ix) + offsets[best % len(offsets)], wrap(iy) + offsets[best // len(offsets)], surface.reshape(m, -1)[np.arange(m), at], usable


def shifts(pairs: DataFrame, size: int, span: float = 0.6, step: float = 0.02, rows: int = 256) -> DataFrame:
    """pairs (..., a, b: arrays of size x size values) with dx, dy and peak in place of a and b; flat patches, and those with a null, have nulls."""
    keep = [c for c in pairs.columns if c not in ("a", "b")]
    new = [T.StructField(c, T.DoubleType()) for c in ("dx", "dy", "peak")]
    schema = T.StructType([pairs.schema[c] for c in keep] + new)

    def plane(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out, known = np.zeros((len(column), size * size)), np.zeros(len(column), bool)
        for i, v in enumerate(column):
            v = v.values if v.is_valid else None
            if v is not None and len(v) == size * size and not v.null_count:
                out[i], known[i] = v.to_numpy(zero_copy_only=False), True
        return out.reshape(-1, size, size), known & np.isfinite(out).all(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, rows):
                batch = whole.slice(first, rows)
                (a, known_a), (b, known_b) = (plane(batch.column(batch.schema.get_field_index(c))) for c in "ab")
                known = known_a & known_b
                *found, usable = correlate(np.where(known[:, None, None], a, 0), np.where(known[:, None, None], b, 0), span, step)
                none = ~(known & usable)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(x.astype(float), mask=none) for x in found], names=schema.names)

    return pairs.select(*keep, "a", "b").mapInArrow(run, schema)
