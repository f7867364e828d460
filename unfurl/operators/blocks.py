"""Growth of one image over several tasks: an operator of its own.

Blocks of whole planes are grown alone, each connected part of a block being a
node. Edges through the faces between blocks vote, by weight, for the wraps between
two nodes; nodes are then joined along a maximum spanning forest of agreeing weight,
found in rounds over tables (every tree takes its best edge; wraps are potentials
that add up along the way), and every voxel is shifted by its node's wraps.

Sequential growth takes edges in one order for the whole image; here that order holds
within blocks only. Where a field has no residues both agree up to a multiple of
2 pi for each connected part; where noise leaves some, paths through blocks may
differ, as README measures. The result is congruent with the phase in any case."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import phase as P
from ..model import Shape
from ..session import cut
from . import _kernel as K
from .slabs import on_slabs
from .weights import edge_weights

KEYS = ["image_id", "echo"]
#: Voxels of a block, at least one plane.
BLOCK = 1 << 17


def plane_of(shape: Shape) -> int:
    """Voxels of a slice along the last dimension that has several."""
    return shape.nx * shape.ny if shape.nz > 1 else shape.nx if shape.ny > 1 else 1


def connected(phase: np.ndarray, weights: np.ndarray, box: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(unwrapped, part): every connected part grown from its best seed, numbered from
    1; voxels without any edge stay as they are, in part 0."""
    n, o = len(phase), K.Options(shape=box)
    linked = np.zeros(n, bool)
    for d, s in enumerate((1, box[0], box[0] * box[1])):
        if s < n:
            there = weights[: n - s, d] > 0
            linked[: n - s] |= there
            linked[s:] |= there
    out, part, number = phase.astype(float), np.zeros(n, np.int32), 0
    while True:
        rest = linked & (part == 0)
        if not rest.any():
            return out, part
        number += 1
        # Voxels of other parts and lone ones count as visited, so the seed is of the rest.
        u, seen = K.grow(out, weights, o, visited=(~rest).astype(np.uint8) * 255)
        new = rest & (seen == 1)
        out[new], part[new] = u[new], number


def grow_alone(voxels: DataFrame, shape: Shape, block: int) -> DataFrame:
    """voxels (phase, w1, w2, w3) with unwrapped and part, block by block."""
    plane = plane_of(shape)

    def kernel(v: dict, lo: int, whole: Shape) -> dict:
        m = v["phase"].shape[1]
        box = (shape.nx, shape.ny, m // plane) if shape.nz > 1 else (shape.nx, m // plane, 1) if shape.ny > 1 else (m, 1, 1)
        done = [connected(p, np.stack(w, axis=1).astype(np.uint8), box) for p, *w in zip(v["phase"], v["w1"], v["w2"], v["w3"])]
        return {"unwrapped": np.stack([u for u, _ in done]), "part": np.stack([r for _, r in done])}

    return on_slabs(voxels, shape, kernel, "unwrapped double, part long", 0, ["phase", "w1", "w2", "w3"], slab=block)


def faces(grown: DataFrame, shape: Shape, block: int) -> DataFrame:
    """(image_id, echo, a, b, wraps, weight): nodes that touch through a face between
    blocks, the wraps by which b lies below a, and the weight that agrees on them."""
    plane = plane_of(shape)
    w = "w3" if shape.nz > 1 else "w2" if shape.ny > 1 else "w1"
    there = grown.where("part > 0")
    left = there.where((F.col("idx") % block >= block - plane) & (F.col(w) > 0))
    left = left.select(*KEYS, (F.col("idx") + plane).alias("idx"), F.col("node").alias("a"), F.col("unwrapped").alias("ua"), (256 - F.col(w)).cast("long").alias("w"))
    right = there.where(F.col("idx") % block < plane).select(*KEYS, "idx", F.col("node").alias("b"), F.col("unwrapped").alias("ub"))
    k = F.rint((F.col("ua") - F.col("ub")) / P.TWO_PI)
    votes = left.join(right, [*KEYS, "idx"]).select(*KEYS, "a", "b", k.cast("long").alias("wraps"), "w").where("wraps is not null")
    each = votes.groupBy(*KEYS, "a", "b", "wraps").agg(F.sum("w").alias("weight"))
    best = F.max(F.struct("weight", (-F.abs("wraps")).alias("small"), "wraps")).alias("best")
    return each.groupBy(*KEYS, "a", "b").agg(best).select(*KEYS, "a", "b", "best.wraps", "best.weight")


def forest(edges: DataFrame) -> DataFrame:
    """(image_id, echo, node, root, wraps): trees of a maximum spanning forest over
    edges (a, b, wraps, weight), and what to add to each node to meet its root. In
    each round every tree hooks on along its best edge; ties go by the edge's nodes,
    so only pairs that hook on each other close a ring, and the smaller then leads."""
    edges = cut(edges)
    nodes = edges.select(*KEYS, F.explode(F.array("a", "b")).alias("node")).distinct()
    label = cut(nodes.select(*KEYS, "node", F.col("node").alias("root"), F.lit(0).cast("long").alias("wraps")))
    while True:
        at = lambda n: label.select(*KEYS, F.col("node").alias(n), F.col("root").alias(f"r{n}"), F.col("wraps").alias(f"p{n}"))
        open_edges = cut(edges.join(at("a"), [*KEYS, "a"]).join(at("b"), [*KEYS, "b"]).where("ra <> rb"))
        if open_edges.isEmpty():
            return label
        up = F.col("wraps") + F.col("pa") - F.col("pb")  # what brings b's tree to a's
        way = lambda r, to, k: F.struct(F.col(r).alias("tree"), F.col(to).alias("to"), k.alias("k"))
        ways = open_edges.select(*KEYS, "a", "b", "weight", F.explode(F.array(way("rb", "ra", up), way("ra", "rb", -up))).alias("w"))
        best = F.max(F.struct("weight", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"), "w.to", "w.k")).alias("m")
        hooks = ways.groupBy(*KEYS, "w.tree").agg(best).select(*KEYS, "tree", F.col("m.to").alias("to"), F.col("m.k").alias("k"))
        hooks = cut(hooks)
        back = hooks.select(*KEYS, F.col("tree").alias("to"), F.col("to").alias("back"))
        hooks = hooks.join(back, [*KEYS, "to"], "left")
        leads = F.col("back").eqNullSafe(F.col("tree")) & (F.col("tree") < F.col("to"))
        hooks = cut(hooks.where(~leads).select(*KEYS, "tree", "to", "k"))
        while True:  # halve the ways to the roots
            above = hooks.select(*KEYS, F.col("tree").alias("to"), F.col("to").alias("top"), F.col("k").alias("more"))
            jumped = cut(hooks.join(above, [*KEYS, "to"], "left"))
            if jumped.where("top is not null").isEmpty():
                break
            hooks = jumped.select(*KEYS, "tree", F.coalesce("top", "to").alias("to"), (F.col("k") + F.coalesce("more", F.lit(0))).alias("k"))
        moved = label.join(hooks.withColumnRenamed("tree", "root"), [*KEYS, "root"], "left")
        label = cut(moved.select(*KEYS, "node", F.coalesce("to", "root").alias("root"), (F.col("wraps") + F.coalesce("k", F.lit(0))).alias("wraps")))


def unwrap_blocks(voxels: DataFrame, shape: Shape, weights="default", tes=None, block: int | None = None) -> DataFrame:
    """voxels with unwrapped double and tree long: the connected part of the image,
    null for voxels without any edge, which stay as they are."""
    plane = plane_of(shape)
    size = max(1, (block or BLOCK) // plane) * plane
    grown = grow_alone(edge_weights(voxels, shape, weights, tes), shape, size)
    node = (F.floor(F.col("idx") / size) * (1 << 31) + F.col("part")).cast("long")
    grown = cut(grown.withColumn("node", node))
    moves = forest(faces(grown, shape, size)).select(*KEYS, "node", F.col("root").alias("top"), "wraps")
    out = grown.join(moves, [*KEYS, "node"], "left")
    tree = F.when(F.col("part") > 0, F.coalesce("top", "node")).alias("tree")
    shifted = F.col("unwrapped") + P.TWO_PI * F.coalesce("wraps", F.lit(0))
    return out.select(*voxels.columns, shifted.alias("unwrapped"), tree)
