"""Voxel tables and volume rows, and the ways between them.

voxels : image_id, echo, idx, phase, mag, mask  - idx dense, x fastest
volumes: image_id, echo, nx, ny, nz, te, phase[], mag[], mask[]
NaN and masked voxels stay rows: neighbours are found by position in idx."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOLUME = "image_id long, echo int, nx int, ny int, nz int, te double, phase array<double>, mag array<double>, mask array<boolean>"


@dataclass(frozen=True)
class Shape:
    nx: int
    ny: int = 1
    nz: int = 1

    @property
    def size(self) -> int:
        return self.nx * self.ny * self.nz

    @property
    def strides(self) -> tuple[int, int, int]:
        return 1, self.nx, self.nx * self.ny

    def coordinates(self, idx: Column) -> tuple[Column, Column, Column]:
        row, plane = F.lit(self.nx), F.lit(self.nx * self.ny)
        return (idx % row).cast("int"), (F.floor(idx / row) % self.ny).cast("int"), F.floor(idx / plane).cast("int")

    def last(self, idx: Column, dim: int) -> Column:
        """Whether a voxel is the last along a dimension (has no edge there)."""
        x = self.coordinates(idx)[dim]
        return x == (self.nx, self.ny, self.nz)[dim] - 1


def to_voxels(volumes: DataFrame) -> DataFrame:
    """One row per array element; a missing mask is all true."""
    arrays = [c for c in ("phase", "mag", "mask") if c in volumes.columns]
    own = [c for c in volumes.columns if c not in arrays]
    rows = volumes.select(*own, *arrays, F.posexplode(F.sequence(F.lit(1), F.size("phase"))).alias("pos", "at"))
    pick = [F.when(F.col(c).isNotNull(), F.element_at(c, F.col("at"))).alias(c) for c in arrays]
    out = rows.select(*own, F.col("pos").cast("long").alias("idx"), *pick)
    return out.withColumn("mask", F.coalesce("mask", F.lit(True))) if "mask" in arrays else out


def to_volumes(voxels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Arrays of one value column by idx. One row per image holds it whole."""
    items = F.array_sort(F.collect_list(F.struct("idx", value)))
    return voxels.groupBy(*keys).agg(F.transform(items, lambda s: s[value]).alias(value))
