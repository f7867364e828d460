"""Edge weights, slab by slab.

Six measures, chosen by flags, multiply to a quality in [0, 1], which is
quantised to 1 (best) to 255 (worst), 0 meaning no edge. The mask is asked at the
left voxel only, so growth may leave it by one voxel in + directions. Stencils
use the linear index; only the edges themselves end at the border."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phase as P
from ..model import Shape
from . import _stencils as K
from .ranks import quantile
from .slabs import on_slabs
from .stencil import ahead, behind, clear_border, order

Flags = tuple[bool, bool, bool, bool, bool, bool]
W123 = "w1 short, w2 short, w3 short"
#: Fixed presets: phase coherence, gradient coherence, linearity, magnitude
#: coherence, magnitude weight, high-magnitude weight.
PRESETS: dict[str, Flags] = {
    "default": (True, True, True, True, False, False),
    "default2": (True, False, False, True, False, False),
    "default3": (True, True, False, True, False, False),
    "default4": (True, True, True, True, False, False),
    "default6": (True, True, True, True, True, True),
}


def flags_of(weights: str | tuple | list) -> Flags:
    """A preset's name, a string of up to six 0/1 or a sequence of booleans."""
    if isinstance(weights, str):
        if weights in PRESETS:
            return PRESETS[weights]
        if not weights or len(weights) > 6 or set(weights) - {"0", "1"}:
            raise ValueError(f"Weight '{weights}' not defined!")
        weights = [c == "1" for c in weights]
    return tuple([*map(bool, weights), *[False] * 6][:6])


def prune(flags: Flags, mag: bool, phase2: bool, tes: bool) -> Flags:
    """Measures without their input are off."""
    f = list(flags)
    if not mag:
        f[3:6] = [False] * 3
    if not (phase2 and tes):
        f[1] = False
    return tuple(f)


def masked_mag(voxels: DataFrame) -> Column:
    """Magnitude inside the mask, 0 outside, also where it is NaN."""
    return F.when(F.col("mask"), F.col("mag")).otherwise(F.lit(0.0)) if "mask" in voxels.columns else F.col("mag")


def max_magnitude(voxels: DataFrame, q: float = 0.95) -> DataFrame:
    """(image_id, echo, maxmag): interpolated quantile of the finite, masked
    magnitude, one row per volume."""
    m = voxels.select("image_id", "echo", masked_mag(voxels).alias("m"))
    return quantile(m.where(P.is_finite(F.col("m"))), ["image_id", "echo"], F.col("m"), q, "maxmag")


def qualities(
    voxels: DataFrame,
    shape: Shape,
    weights="default",
    tes: tuple[float, float] | None = None,
    rescale: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """voxels with q1, q2, q3, the combined edge qualities per dimension, rescaled
    if asked; outside mask, array and border they are 0. Uses mag, mask and
    phase2 where the columns exist. A projection over one window of an image, for
    images that fit a task; edge_weights() and the voxel qualities work on slabs."""
    has = voxels.columns
    flags = prune(flags_of(weights), "mag" in has, "phase2" in has, tes is not None)
    df, w = voxels, order()
    if any(flags[3:]):
        df = df.withColumn("mag_in", masked_mag(df))
    if flags[4] or flags[5]:
        df = df.join(max_magnitude(df.drop("mag_in")), ["image_id", "echo"], "left")
    out = {}
    for d, s in enumerate(shape.strides):
        a, b = F.col("phase"), ahead("phase", s, w)
        used: list[Column] = []
        if flags[0]:
            used.append(P.coherence(a, b))
        if flags[1]:
            used.append(P.gradient_coherence(a, b, F.col("phase2"), ahead("phase2", s, w), tes[0] / tes[1]))
        if flags[2]:
            used.append(P.edge_linearity(behind("phase", s, w), a, b, ahead("phase", 2 * s, w)))
        if any(flags[3:]):
            m, n = F.col("mag_in"), ahead("mag_in", s, w)
            if flags[3]:
                used.append(P.mag_coherence(m, n))
            if flags[4]:
                used.append(P.mag_weight(m, n, F.col("maxmag")))
            if flags[5]:
                used.append(P.mag_weight_high(m, n, F.col("maxmag")))
        q = P.combine(used)
        q = rescale(q) if rescale else q
        there = b.isNotNull() & (F.col("mask") if "mask" in has else F.lit(True))
        out[f"q{d + 1}"] = clear_border(F.when(there, q).otherwise(F.lit(0).cast("short") if rescale is P.quantise else F.lit(0.0)), shape, d, 0)
    return df.withColumns(out).drop("mag_in", "maxmag")


def with_maxmag(voxels: DataFrame, flags: Flags) -> DataFrame:
    """voxels with their volume's maxmag, where a measure needs it."""
    if not (flags[4] or flags[5]):
        return voxels
    return voxels.join(F.broadcast(max_magnitude(voxels)), ["image_id", "echo"], "left")


def slab_inputs(voxels: DataFrame, weights, tes) -> tuple[DataFrame, Flags, float | None, list[str]]:
    """What a kernel of qualities needs: voxels, flags, ratio of echo times, columns."""
    has = voxels.columns
    flags = prune(flags_of(weights), "mag" in has, "phase2" in has, tes is not None)
    df = with_maxmag(voxels, flags)
    wanted = {"phase": True, "phase2": flags[1], "mag": any(flags[3:]), "maxmag": flags[4] or flags[5], "mask": "mask" in has}
    return df, flags, tes[0] / tes[1] if tes else None, [c for c, used in wanted.items() if used]


def edge_weights(voxels: DataFrame, shape: Shape, weights="default", tes=None, user: DataFrame | None = None, slab: int | None = None) -> DataFrame:
    """voxels with w1, w2, w3 smallint, slab by slab. weights is a preset, flags or
    'bestpath'; user gives a table (image_id, idx, dim, w) of the caller's own."""
    if user is not None:
        wide = user.groupBy("image_id", "idx").agg(
            *[F.max(F.when(F.col("dim") == d, F.col("w"))).cast("short").alias(f"w{d + 1}") for d in range(3)]
        )
        df = voxels.join(wide, ["image_id", "idx"], "left")
        return df.withColumns({f"w{d + 1}": clear_border(F.coalesce(f"w{d + 1}", F.lit(0).cast("short")), shape, d, 0).cast("short") for d in range(3)})
    plane = shape.nx * shape.ny
    if weights == "bestpath":
        columns = [c for c in ("phase", "mask") if c in voxels.columns]
        return on_slabs(voxels, shape, K.bestpath, W123, 2 * plane + shape.nx + 3, columns, slab=slab)
    df, flags, ratio, columns = slab_inputs(voxels, weights, tes)
    return on_slabs(df, shape, lambda v, lo, box: K.edge_weights(v, lo, box, flags, ratio), W123, 2 * plane, columns, keep=voxels.columns, slab=slab)


def echo_pair(voxels: DataFrame, template: int, partner: int) -> DataFrame:
    """The template echo with the partner echo's phase as phase2."""
    second = voxels.where(F.col("echo") == partner).select("image_id", "idx", F.col("phase").alias("phase2"))
    return voxels.where(F.col("echo") == template).join(second, ["image_id", "idx"])


def second_difference(voxels: DataFrame, shape: Shape, slab: int | None = None) -> DataFrame:
    """voxels with d: root of the summed squared second differences over the
    distinct linear offsets of the 26 neighbours, where both sides exist."""
    return on_slabs(voxels, shape, K.second_difference, "d double", shape.nx * shape.ny + shape.nx + 1, ["phase"], slab=slab)


def nonzero(weights: DataFrame) -> DataFrame:
    """(image_id, echo) of volumes whose weights are all zero; unwrapping them is
    an error."""
    return weights.groupBy("image_id", "echo").agg(F.sum(F.col("w1") + F.col("w2") + F.col("w3")).alias("total")).where("total = 0")
