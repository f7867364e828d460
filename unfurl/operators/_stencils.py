"""Stencils on stacks of equal ranges of voxels, in numpy.

Values are arrays (ranges, voxels); column j is voxel lo + j of the image, x
fastest. Taps outside a range are missing: NaN for values, False for `there`."""

from __future__ import annotations

import math

import numpy as np

from ..model import Shape

PI, TWO_PI, BINS = math.pi, 2 * math.pi, 256
#: Factor of the weakest edge per measure.
FLOOR = 0.1
Values = dict[str, np.ndarray]


def wrap_once(x: np.ndarray) -> np.ndarray:
    return np.where(x < -PI, x + TWO_PI, np.where(x > PI, x - TWO_PI, x))


def wrap_full(x: np.ndarray) -> np.ndarray:
    return x - TWO_PI * np.rint(x / TWO_PI)


def tap(x: np.ndarray, n: int, missing=np.nan) -> np.ndarray:
    """x[:, j + n] at j."""
    out = np.full(x.shape, missing, x.dtype)
    m = x.shape[1]
    if n >= 0:
        out[:, : max(m - n, 0)] = x[:, n:]
    elif m + n > 0:
        out[:, -n:] = x[:, :n]
    return out


def has(shape: Shape, lo: int, m: int, n: int) -> np.ndarray:
    """Whether voxel j + n is in the image."""
    at = np.arange(lo, lo + m) + n
    return (at >= 0) & (at < shape.size)


def is_last(shape: Shape, lo: int, m: int, dim: int) -> np.ndarray:
    """Whether a voxel is the last along a dimension."""
    at = np.arange(lo, lo + m) // shape.strides[dim]
    size = (shape.nx, shape.ny, shape.nz)[dim]
    return (at % size if dim < 2 else at) == size - 1


def linearity(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    v = np.maximum(0, 1 - np.abs(wrap_full(a - 2 * b + c) / 2))
    return np.where(np.isnan(v), 0.5, v)


def qualities(v: Values, lo: int, shape: Shape, flags: tuple, ratio: float | None) -> list[np.ndarray]:
    """Edge qualities along each dimension, 0 outside mask, array and border, NaN
    where phases or magnitudes are. v: phase, and phase2, mag, maxmag, mask if there."""
    phase, mag, mask = v["phase"], v.get("mag"), v.get("mask")
    m, out = phase.shape[1], []
    if mag is not None and mask is not None:
        mag = np.where(mask, mag, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        for d, s in enumerate(shape.strides):
            there = has(shape, lo, m, s)
            nxt = tap(phase, s)
            step, w = wrap_once(phase - nxt), np.ones(phase.shape)
            if flags[0]:
                w = w * (FLOOR + (1 - FLOOR) * (1 - np.abs(step / PI)))
            if flags[1]:
                p2 = v["phase2"]
                w = w * (FLOOR + (1 - FLOOR) * np.maximum(0, 1 - np.abs(step - wrap_once(p2 - tap(p2, s)) * ratio)))
            if flags[2]:
                both = linearity(tap(phase, -s), phase, nxt) * linearity(phase, nxt, tap(phase, 2 * s))
                w = w * (FLOOR + (1 - FLOOR) * np.where(has(shape, lo, m, -s) & has(shape, lo, m, 2 * s), both, 0.9))
            if any(flags[3:]):
                other = tap(mag, s)
                small, big = np.minimum(mag, other), np.maximum(mag, other)
                if flags[3]:
                    q = small / big
                    w = w * (FLOOR + (1 - FLOOR) * (q * q))
                if flags[4]:
                    w = w * (FLOOR + (1 - FLOOR) * (0.5 + 0.5 * np.fmin(1.0, small / (0.5 * v["maxmag"]))))
                if flags[5]:
                    w = w * (FLOOR + (1 - FLOOR) * (0.5 + 0.5 * np.fmin(1.0, (0.5 * v["maxmag"]) / big)))
            ok = there & ~is_last(shape, lo, m, d)
            out.append(np.where(ok if mask is None else ok & mask, w, 0.0))
    return out


def quantise(q: np.ndarray) -> np.ndarray:
    """[0, 1] to 255..1, best first; anything else, NaN too, to 0 (no edge)."""
    with np.errstate(invalid="ignore"):
        ok = (q >= 0) & (q <= 1)
        return np.where(ok, np.maximum(np.rint((1 - np.where(ok, q, 0)) * (BINS - 1)), 1), 0)


def edge_weights(v: Values, lo: int, shape: Shape, flags: tuple, ratio: float | None) -> Values:
    there = v.get("mask")
    out = {}
    for d, q in enumerate(qualities(v, lo, shape, flags, ratio)):
        m = q.shape[1]
        ok = has(shape, lo, m, shape.strides[d]) & ~is_last(shape, lo, m, d)
        out[f"w{d + 1}"] = np.where(ok if there is None else ok & there, quantise(q), 0).astype(np.int16)
    return out


def voxel_quality(v: Values, lo: int, shape: Shape, flags: tuple, ratio: float | None) -> Values:
    """Outgoing plus incoming edge qualities over six."""
    qs = qualities(v, lo, shape, flags, ratio)
    total = qs[0] + qs[1] + qs[2]
    for q, s in zip(qs, shape.strides):
        total = total + tap(q, -s, 0.0)
    return {"quality": (total / 6).astype(np.float32)}


def second_difference(v: Values, lo: int, shape: Shape) -> Values:
    """Root of the summed squared second differences over the distinct linear offsets
    of the 26 neighbours, where both sides exist."""
    phase = v["phase"]
    m, (sx, sy, sz) = phase.shape[1], shape.strides
    offsets = sorted({abs(sx * i + sy * j + sz * k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)} - {0})
    total = np.zeros(phase.shape)
    for n in offsets:
        diff = wrap_once(tap(phase, -n) - phase) - wrap_once(phase - tap(phase, n))
        total = total + np.where(has(shape, lo, m, n) & has(shape, lo, m, -n), diff * diff, 0.0)
    return {"d": np.sqrt(total)}


def bestpath(v: Values, lo: int, shape: Shape) -> Values:
    """Reliabilities 1/d of both voxels of an edge, added and quantised. The sum for
    voxel i lands on the next voxel's edge; the first voxel's edges get the worst."""
    if np.isnan(v["phase"]).any():
        raise ValueError("best-path weights need a phase without NaN")
    d = second_difference(v, lo, shape)["d"]
    with np.errstate(divide="ignore", invalid="ignore"):
        r, m, out = 1 / d, d.shape[1], {}
        for k, s in enumerate(shape.strides):
            moved = np.where(has(shape, lo, m, -1) & has(shape, lo, m, s - 1), tap(r + tap(r, s), -1), 0.0)
            scaled = np.clip(np.rint((1 - moved / 10) * (BINS - 1)), 1, BINS - 1)
            ok = ~is_last(shape, lo, m, k) & v.get("mask", True)
            out[f"w{k + 1}"] = np.where(ok, scaled, 0).astype(np.int16)
    return out


def neighbours(v: Values, lo: int, shape: Shape) -> Values:
    """Each value one voxel ahead along each dimension, as <value><dim>, 0 and NaN
    behind the end; inside<dim> says whether there is one."""
    out = {}
    for d, s in enumerate(shape.strides):
        for c, x in v.items():
            out[f"{c}{d}"] = tap(x, s, np.nan if x.dtype.kind == "f" else 0)
        m = next(iter(v.values())).shape
        out[f"inside{d}"] = np.broadcast_to(has(shape, lo, m[1], s) & ~is_last(shape, lo, m[1], d), m)
    return out


def gaussian(sigma: float, size: int) -> np.ndarray:
    """Taps from -r to r, 3 sigma at most and not beyond an axis."""
    r = min(int(np.ceil(3 * sigma)), size - 1)
    return np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)


def smooth_planes(v: Values, lo: int, shape: Shape, sigma: tuple[float, ...]) -> Values:
    """Along x and y, in ranges of whole planes; at borders over the voxels there are."""
    out = {}
    for c, x in v.items():
        planes = x.reshape(-1, shape.ny, shape.nx)
        for axis, s in ((2, sigma[0]), (1, sigma[1])):
            size = planes.shape[axis]
            if s > 0 and size > 1:
                k = gaussian(s, size)
                r = len(k) // 2
                moved = np.moveaxis(planes, axis, -1)
                total, weight = np.zeros(moved.shape), np.zeros(size)
                for j, g in zip(range(-r, r + 1), k):
                    to, fro = slice(max(0, -j), size - max(0, j)), slice(max(0, j), size - max(0, -j))
                    total[..., to] += g * moved[..., fro]
                    weight[to] += g
                planes = np.moveaxis(total / weight, -1, axis)
        out[c] = planes.reshape(x.shape)
    return out


def smooth_depth(v: Values, lo: int, shape: Shape, sigma: float) -> Values:
    """Along z, plane by plane."""
    m = next(iter(v.values())).shape[1]
    k, plane = gaussian(sigma, shape.nz), shape.nx * shape.ny
    r = len(k) // 2
    weight = sum(g * has(shape, lo, m, j * plane) for j, g in zip(range(-r, r + 1), k))
    return {c: sum(g * np.where(has(shape, lo, m, j * plane), tap(x, j * plane, 0.0), 0.0) for j, g in zip(range(-r, r + 1), k)) / weight for c, x in v.items()}
