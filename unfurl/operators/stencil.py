"""Neighbour access on the linear index: every tap is a lag or lead in one
window over (image, echo) by idx, so all of them share one exchange and sort."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..model import Shape


def order(keys: tuple[str, ...] = ("image_id", "echo")) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("idx")


def ahead(value: str, offset: int, w: WindowSpec) -> Column:
    return F.lead(value, offset).over(w) if offset else F.col(value)


def behind(value: str, offset: int, w: WindowSpec) -> Column:
    return F.lag(value, offset).over(w) if offset else F.col(value)


def clear_border(value: Column, shape: Shape, dim: int, zero) -> Column:
    return F.when(shape.last(F.col("idx"), dim), F.lit(zero)).otherwise(value)


def edges(voxels, shape: Shape, columns: list[str]):
    """Edge relation: one row per voxel and dimension with a right neighbour, the
    listed columns as left_ and right_."""
    w = order()
    wide = voxels
    for d, s in enumerate(shape.strides):
        for c in columns:
            wide = wide.withColumn(f"right{d}_{c}", ahead(c, s, w))
    parts = F.array(
        *[
            F.struct(
                F.lit(d).alias("dim"),
                (~shape.last(F.col("idx"), d)).alias("inside"),
                *[F.col(f"right{d}_{c}").alias(f"right_{c}") for c in columns],
            )
            for d in range(3)
        ]
    )
    keep = [c for c in voxels.columns if c not in columns]
    rows = wide.select(*keep, *[F.col(c).alias(f"left_{c}") for c in columns], F.explode(parts).alias("e"))
    return rows.where("e.inside").select(*keep, *[f"left_{c}" for c in columns], "e.dim", *[f"e.right_{c}" for c in columns])
