"""Phase offsets and coil combination by the published multi-echo method: the
phase difference of two echoes, summed over channels, gives the field; what is
left of the first echo is each channel's offset, smoothed as a complex number.

The sums over channels are relational. Voxel tables are smoothed slab by slab, an
axis at a time; volume rows image by image."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Shape
from . import _kernel as K
from . import _stencils as S
from . import grow
from .slabs import SLAB, on_slabs


def phase_difference(voxels: DataFrame, first: int = 1, second: int = 2) -> DataFrame:
    """(image_id, idx, hip, weight): angle and length of the sum over channels of
    m1 m2 exp(i (phase2 - phase1)). voxels: image_id, channel, echo, idx, phase, mag."""
    a = voxels.where(F.col("echo") == first).select("image_id", "channel", "idx", F.col("phase").alias("p1"), F.col("mag").alias("m1"))
    b = voxels.where(F.col("echo") == second).select("image_id", "channel", "idx", F.col("phase").alias("p2"), F.col("mag").alias("m2"))
    d, m = F.col("p2") - F.col("p1"), F.col("m1") * F.col("m2")
    s = a.join(b, ["image_id", "channel", "idx"]).groupBy("image_id", "idx").agg(F.sum(m * F.cos(d)).alias("re"), F.sum(m * F.sin(d)).alias("im"))
    return s.select("image_id", "idx", F.atan2("im", "re").alias("hip"), F.hypot("re", "im").alias("weight"))


def combine_channels(voxels: DataFrame, offsets: DataFrame) -> DataFrame:
    """(image_id, echo, idx, phase, mag) of the channels' sum after removing each
    one's offset (image_id, channel, idx, offset)."""
    p = F.col("phase") - F.col("offset")
    s = voxels.join(offsets, ["image_id", "channel", "idx"]).groupBy("image_id", "echo", "idx").agg(
        F.sum(F.col("mag") * F.cos(p)).alias("re"), F.sum(F.col("mag") * F.sin(p)).alias("im"), F.sum(F.col("mag") * F.col("mag")).alias("mm")
    )
    return s.select("image_id", "echo", "idx", F.atan2("im", "re").alias("phase"), F.sqrt("mm").alias("mag"))


def correct_images(volumes: DataFrame, tes: tuple[float, ...], sigma: tuple[float, float, float], bipolar: bool = False, by_size: bool = False) -> DataFrame:
    """volumes (image_id, channel, echo, nx, ny, nz, phase, mag) with every channel's
    offset removed and the channels combined: one row per image and echo with phase
    and mag, and the offsets (one array a channel, by channel) with each. An image
    of all its channels is one group; magnitudes that are null count 1. With by_size
    sigma is in the units of columns dx, dy and dz, the voxels' sizes."""

    def image(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["channel", "echo"])
        shape = tuple(int(pdf[c].iloc[0]) for c in ("nx", "ny", "nz"))
        echoes, channels = sorted(set(pdf["echo"])), pdf["channel"].nunique()
        if len(pdf) != len(echoes) * channels:
            raise ValueError("every channel must have the same echoes")
        grid = (channels, len(echoes), -1)
        phases = np.stack([np.asarray(x, float) for x in pdf["phase"]])
        mags = np.stack([np.ones(phases.shape[1]) if x is None else np.asarray(x, float) for x in pdf["mag"]])
        steps = [float(pdf[f"d{a}"].iloc[0]) for a in "xyz"] if by_size else (1.0, 1.0, 1.0)
        own = tuple(a / b if b else 0.0 for a, b in zip(sigma, steps))
        phase, mag, po = correct(phases.reshape(grid), mags.reshape(grid), tes, shape, own, bipolar)
        same = [pdf["image_id"].iloc[0]] * len(echoes)
        size = {f"n{a}": [s] * len(echoes) for a, s in zip("xyz", shape)}
        return pd.DataFrame({"image_id": same, "echo": echoes, **size, "phase": list(phase), "mag": list(mag), "offsets": [list(po)] * len(echoes)})

    fields = "image_id long, echo int, nx int, ny int, nz int, phase array<double>, mag array<double>, offsets array<array<double>>"
    return volumes.select("image_id", "channel", "echo", "nx", "ny", "nz", *(["dx", "dy", "dz"] if by_size else []), "phase", "mag").groupBy("image_id").applyInPandas(image, fields)


def smooth_voxels(voxels: DataFrame, shape: Shape, sigma: tuple[float, float, float], columns: tuple[str, ...] = ("re", "im"), keys: tuple[str, ...] = ("image_id",), slab: int | None = None) -> DataFrame:
    """voxels with columns smoothed as smooth() does, by two passes over slabs: along x
    and y in slabs of whole planes, then along z in slabs with halos of 3 sigma."""
    plane = shape.nx * shape.ny
    size = max(1, (slab or SLAB) // plane) * plane
    names, made = voxels.columns, ", ".join(f"_{c} double" for c in columns)
    rest = [c for c in names if c not in columns]

    def done(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`_{c}`" if c in columns else f"`{c}`").alias(c) for c in names])

    def flat(v: dict, lo: int, box: Shape) -> dict:
        return {f"_{c}": x for c, x in S.smooth_planes(v, lo, box, sigma).items()}

    def deep(v: dict, lo: int, box: Shape) -> dict:
        return {f"_{c}": x for c, x in S.smooth_depth(v, lo, box, sigma[2]).items()}

    df = done(on_slabs(voxels, shape, flat, made, 0, list(columns), keys, rest, size))
    if sigma[2] <= 0 or shape.nz == 1:
        return df
    reach = min(math.ceil(3 * sigma[2]), shape.nz - 1) * plane
    return done(on_slabs(df, shape, deep, made, reach, list(columns), keys, rest, size))


def channel_offsets(voxels: DataFrame, shape: Shape, tes: tuple[float, float], sigma: tuple[float, float, float], slab: int | None = None) -> DataFrame:
    """(image_id, channel, idx, offset) for combine_channels(): what the field of the
    first two echoes, unwrapped, leaves of each channel's first echo, smoothed. Voxels
    as for phase_difference(); all but the unwrapping works on slabs."""
    field = phase_difference(voxels).select("image_id", F.lit(1).alias("echo"), "idx", F.col("hip").alias("phase"), F.col("weight").alias("mag"))
    field = grow.unwrap(field, shape).select("image_id", "idx", F.col("unwrapped").alias("field"))
    first = voxels.where("echo = 1").join(field, ["image_id", "idx"])
    raw = F.col("phase") - F.col("field") * (tes[0] / (tes[1] - tes[0]))
    z = first.select("image_id", "channel", "idx", (F.col("mag") * F.cos(raw)).alias("re"), (F.col("mag") * F.sin(raw)).alias("im"))
    return smooth_voxels(z, shape, sigma, keys=("image_id", "channel"), slab=slab).select("image_id", "channel", "idx", F.atan2("im", "re").alias("offset"))


def smooth(z: np.ndarray, shape, sigma) -> np.ndarray:
    """Separable Gaussian of a flat complex volume, edges renormalised."""
    v, w = z.reshape(shape, order="F"), np.ones(shape)
    for axis, s in enumerate(sigma):
        if s <= 0 or shape[axis] == 1:
            continue
        r = min(int(np.ceil(3 * s)), shape[axis] - 1)
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
        run = lambda x: np.apply_along_axis(lambda a: np.convolve(a, k)[r : r + len(a)], axis, x)  # noqa: E731, B023
        v, w = run(v), run(w)
    return (v / w).ravel(order="F")


def correct(phases: np.ndarray, mags: np.ndarray, tes, shape, sigma, bipolar: bool = False):
    """phases, mags: (channel, echo, voxel). (combined phase and mag per echo,
    offsets per channel)."""
    phases, mags = np.nan_to_num(phases), np.nan_to_num(mags)
    if bipolar:
        if phases.shape[1] < 3:
            raise ValueError("bipolar phase offset correction needs at least 3 echoes")
        swing = (mags[:, 0] * mags[:, 1] * np.exp(1j * (phases[:, 0] - 2 * phases[:, 1] + phases[:, 2]))).sum(0)
        g = np.angle(smooth(swing, shape, sigma)) / 4
        sign = np.where(np.arange(phases.shape[1]) % 2 == 0, 1, -1)
        phases = phases - sign[None, :, None] * g[None, None, :]
    hip = (mags[:, 0] * mags[:, 1] * np.exp(1j * (phases[:, 1] - phases[:, 0]))).sum(0)
    field, _ = K.unwrap3d(np.angle(hip), K.Options(shape=tuple(shape)), np.abs(hip))
    raw = phases[:, 0] - field[None] * (tes[0] / (tes[1] - tes[0]))
    po = np.array([np.angle(smooth(m * np.exp(1j * p), shape, sigma)) for m, p in zip(mags[:, 0], raw)])
    z = (mags * np.exp(1j * (phases - po[:, None, :]))).sum(0)
    return np.angle(z), np.sqrt((mags**2).sum(0)), po
