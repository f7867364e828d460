"""What follows unwrapping: global and multi-echo corrections, thresholds, masks,
echo selection and purely temporal unwrapping, all as aggregates and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phase as P
from ..session import cut
from .ranks import median_of_whole


def correct_global(voxels: DataFrame, value: str = "unwrapped") -> DataFrame:
    """Subtracts 2 pi times the median number of wraps of the finite voxels in
    the mask, per volume."""
    keys = ["image_id", "echo"]
    inside = P.is_finite(F.col(value)) & (F.col("mask") if "mask" in voxels.columns else F.lit(True))
    m = median_of_whole(voxels.where(inside), keys, F.rint(F.col(value) / P.TWO_PI), "wraps")
    return voxels.join(m, keys, "left").withColumn(value, F.col(value) - P.TWO_PI * F.coalesce("wraps", F.lit(0.0))).drop("wraps")


def by_echo(voxels: DataFrame, echoes: int, value: str) -> DataFrame:
    """(image_id, idx, e1..eN): echoes side by side, one shuffle."""
    return voxels.groupBy("image_id", "idx").agg(*[F.max(F.when(F.col("echo") == e, F.col(value))).alias(f"e{e}") for e in range(1, echoes + 1)])


def temporal_unwrap(wide: DataFrame, tes: list[float], template: int = 1) -> DataFrame:
    """by_echo()'s columns with the template unwrapped already: the others follow
    outwards from it, each against its neighbour scaled by echo times."""
    out: dict[int, Column] = {template: F.col(f"e{template}")}
    df = wide
    for e in [*range(template - 1, 0, -1), *range(template + 1, len(tes) + 1)]:
        r = e + 1 if e < template else e - 1
        df = df.withColumn(f"e{e}", P.unwrap_to(F.col(f"e{e}"), P.echo_reference(F.col(f"e{r}"), tes[e - 1], tes[r - 1])))
    return df


def correct_echoes(wide: DataFrame, tes: list[float]) -> DataFrame:
    """Adds to each echo after the first the median number of wraps by which it
    lags its predecessor; echoes in order, one small aggregate each. wide and the
    aggregates are written once: computed anew for each use, their sorts and hash
    tables would lie in one task side by side, twice as many with every echo."""
    df = cut(wide)
    for e in range(2, len(tes) + 1):
        a, b = F.col(f"e{e - 1}"), F.col(f"e{e}")
        both = df.where(P.is_finite(a) & P.is_finite(b))
        m = cut(median_of_whole(both, ["image_id"], F.rint((a * (tes[e - 1] / tes[e - 2]) - b) / P.TWO_PI), "wraps"))
        df = df.join(m, "image_id", "left").withColumn(f"e{e}", b + P.TWO_PI * F.coalesce("wraps", F.lit(0.0))).drop("wraps")
    return df


def threshold(value: Column, wraps: float) -> Column:
    """0 beyond so many wraps; NaN stays."""
    return F.when(~F.isnan(value) & (F.abs(value) > wraps * P.TWO_PI), F.lit(0.0)).otherwise(value)


def masked(value: Column, mask: Column) -> Column:
    return F.when(mask, value).otherwise(F.lit(0.0))


def select_echoes(voxels: DataFrame, echoes: list[int]) -> DataFrame:
    return voxels.where(F.col("echo").isin(echoes))
