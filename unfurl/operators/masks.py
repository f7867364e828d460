"""Masks. The robust mask is a definition of our own: voxels above a share of the
0.95 quantile of the finite values; for quality maps, above a given quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import phase as P
from .ranks import quantile

ROBUST_SHARE = 0.1


def robust_mask(voxels: DataFrame, value: str = "mag", threshold: float | None = None) -> DataFrame:
    """voxels with mask boolean, per volume; NaN is outside."""
    keys = ["image_id", "echo"]
    v = F.col(value)
    if threshold is not None:
        return voxels.withColumn("mask", ~F.isnan(v) & (v > threshold))
    q = quantile(voxels.where(P.is_finite(v)), keys, v, 0.95, "limit").withColumn("limit", ROBUST_SHARE * F.col("limit"))
    return voxels.join(q, keys, "left").withColumn("mask", F.coalesce(~F.isnan(v) & (v > F.col("limit")), F.lit(False))).drop("limit")


def mask_from(voxels: DataFrame, masks: DataFrame) -> DataFrame:
    """voxels with mask from a table (image_id, idx, mask); non-zero is inside. A
    voxel without one, or a mask's value without a voxel, is an error when the
    result is computed: no job runs before."""
    here = voxels.select("image_id").distinct()
    own = masks.join(here, "image_id", "left_semi").select("image_id", "idx", (F.col("mask").cast("double") != 0).alias("inside"), F.lit(True).alias("given"))
    rows = voxels.drop("mask").withColumn("is_voxel", F.lit(True)).join(own, ["image_id", "idx"], "full")
    wrong = F.concat(F.lit("size of mask differs from that of image "), F.col("image_id").cast("string"), F.lit(" at voxel "), F.col("idx").cast("string"))
    inside = F.when(F.col("is_voxel") & F.col("given"), F.coalesce("inside", F.lit(False))).otherwise(F.raise_error(wrong).cast("boolean"))
    return rows.select(*[c for c in voxels.columns if c != "mask"], inside.alias("mask"))
