"""Region tables over labelled voxels: sizes, touching offsets, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import phase as P
from ..model import Shape
from ._stencils import neighbours
from .ranks import median_of_whole, ranks
from .slabs import SLAB, on_slabs
from .stencil import edges

KEYS = ("image_id", "echo")


def seed_order(weights: DataFrame, slab: int = SLAB) -> DataFrame:
    """weights with rank: the order in which voxels are tried as seeds."""
    total = sum(F.when(F.col(w) == 0, 255).otherwise(F.col(w).cast("int")) for w in ("w1", "w2", "w3"))
    return ranks(weights.withColumn("seed_sum", total), list(KEYS), "seed_sum", "idx", slab)


def seed_offset(phase, phase2, te1: float, te2: float):
    """Wraps to add to a seed: of 15 combinations the first with the least
    mismatch of the two echoes, small wraps preferred."""
    tries = [(a, b) for a in range(-2, 3) for b in range(-1, 2)]
    costs = F.array(
        *[
            F.struct(
                (F.abs((phase + P.TWO_PI * a) / te1 - (phase2 + P.TWO_PI * b) / te2) + (abs(a) + abs(b)) / 100).alias("cost"),
                F.lit(i).alias("i"),
                F.lit(a).alias("a"),
            )
            for i, (a, b) in enumerate(tries)
        ]
    )
    return F.array_min(costs)["a"]


def region_sizes(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy(*KEYS, "region").agg(F.count(F.lit(1)).alias("size"))


def region_offsets(voxels: DataFrame, shape: Shape, value: str = "unwrapped") -> DataFrame:
    """(image_id, echo, ri, rj, offset_sum, weight_sum) over touching voxels of
    different regions, both directions; needs w1, w2, w3. Neighbours are found slab
    by slab; sums per pair are combined before their shuffle."""
    made = ", ".join(f"region{d} short, {value}{d} double" for d in range(3))
    own = [*KEYS, "idx", "region", value, "w1", "w2", "w3"]
    wide = on_slabs(voxels, shape, neighbours, made, shape.nx * shape.ny, ["region", value], keep=own)
    parts = F.array(
        *[
            F.struct(
                F.col(f"region{d}").alias("rj"),
                (F.col(value) - F.col(f"{value}{d}")).alias("diff"),
                F.when(F.col(f"w{d + 1}") == 0, 0).otherwise(255 - F.col(f"w{d + 1}").cast("int")).alias("w"),
                (~shape.last(F.col("idx"), d)).alias("ok"),
            )
            for d in range(3)
        ]
    )
    e = wide.select(*KEYS, F.col("region").alias("ri"), F.explode(parts).alias("e")).where("e.ok and ri <> 0 and e.rj <> 0 and ri <> e.rj")
    flat = e.select(*KEYS, "ri", "e.rj", (F.col("e.diff") * F.col("e.w")).alias("o"), F.col("e.w").alias("w"))
    both = flat.select(
        *KEYS, F.explode(F.array(F.struct("ri", "rj", "o", "w"), F.struct(F.col("rj").alias("ri"), F.col("ri").alias("rj"), (-F.col("o")).alias("o"), F.col("w")))).alias("p")
    ).select(*KEYS, "p.*")
    return both.groupBy(*KEYS, "ri", "rj").agg(F.sum("o").alias("offset_sum"), F.sum("w").cast("long").alias("weight_sum"))


def correct_regions(voxels: DataFrame, value: str = "unwrapped") -> DataFrame:
    """Brings each region's median closest to 0 by multiples of 2 pi."""
    shift = median_of_whole(voxels.where("region <> 0"), [*KEYS, "region"], F.rint(F.col(value) / P.TWO_PI), "wraps")
    df = voxels.join(shift, [*KEYS, "region"], "left")
    return df.withColumn(value, F.col(value) - P.TWO_PI * F.coalesce("wraps", F.lit(0.0))).drop("wraps")


def boundary_edges(voxels: DataFrame, shape: Shape, visited: str = "visited") -> DataFrame:
    """(image_id, echo, idx, dim, edge) of edges with exactly one visited end, from
    which growth of a partly known volume continues."""
    e = edges(voxels.select(*KEYS, "idx", visited), shape, [visited])
    return e.where(F.col(f"left_{visited}") != F.col(f"right_{visited}")).select(*KEYS, "idx", "dim", P.edge_id(F.col("idx"), F.col("dim")).alias("edge"))
