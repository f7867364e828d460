"""Voxel quality: the mean of a voxel's six edge qualities, 0 to 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Shape
from . import _stencils as K
from .slabs import on_slabs
from .weights import Flags, echo_pair, flags_of, slab_inputs


def voxel_quality(voxels: DataFrame, shape: Shape, weights="default", tes=None, slab: int | None = None) -> DataFrame:
    """voxels with quality float: outgoing plus incoming edge qualities over six."""
    if weights == "bestpath":
        raise ValueError("best-path weights have no quality between 0 and 1")
    df, flags, ratio, columns = slab_inputs(voxels, weights, tes)
    kernel = lambda v, lo, box: K.voxel_quality(v, lo, box, flags, ratio)
    return on_slabs(df, shape, kernel, "quality float", 2 * shape.nx * shape.ny, columns, keep=voxels.columns, slab=slab)


def voxel_quality_4d(voxels: DataFrame, shape: Shape, tes: list[float], weights="default", template: int = 1, partner: int = 2) -> DataFrame:
    """Quality of the template echo of multi-echo voxels; the partner stays echo 2
    whatever the template is."""
    return voxel_quality(echo_pair(voxels, template, partner), shape, weights, (tes[template - 1], tes[partner - 1]))


def unwrapped_quality(voxels: DataFrame, shape: Shape) -> DataFrame:
    """Quality of an unwrapped phase against its reference (phase2). Both are
    halved, so that wraps, which change no ordinary quality, lower this one."""
    half = voxels.withColumns({"phase": F.col("phase") / 2, "phase2": F.col("phase2") / 2})
    return voxel_quality(half.drop("mag", "mask"), shape, "default", (1.0, 1.0))


def single_flags() -> list[Flags]:
    return [flags_of([i == k for i in range(6)]) for k in range(6)]


def quality_per_flag(voxels: DataFrame, shape: Shape, tes=None) -> dict[int, DataFrame]:
    """Flag number (1-6) to quality map; constant maps are told by interior_is_one."""
    return {k + 1: voxel_quality(voxels, shape, f, tes) for k, f in enumerate(single_flags())}


def interior_is_one(quality: DataFrame, shape: Shape) -> DataFrame:
    """(image_id, skipped): whether all values before the last planes are 1."""
    inside = ~shape.last(F.col("idx"), 0) & ~shape.last(F.col("idx"), 1) & ~shape.last(F.col("idx"), 2)
    return quality.groupBy("image_id").agg(F.coalesce(F.bool_and(F.when(inside, F.col("quality") == 1.0)), F.lit(True)).alias("skipped"))
