"""Merging of regions as an operation on tables: which region joins which, and by how
many wraps, is decided from sizes and touching sums alone; voxels are relabelled by
a join.

An image has at most 255 regions, so its table of pairs is bounded (65,025 rows) and
one group; images are independent. The largest region not yet settled is a root, the
first such on ties. Regions touching a settled one follow in order of touching
weight, pairs first seen by their second, then first region, and are shifted by the
rounded mean difference; a region with nothing to shift keeps its label. Labels and
wraps are a union-find whose potentials are whole numbers of wraps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import phase as P
from ..model import Shape
from .regions import KEYS, region_offsets, region_sizes
from .slabs import dealt, runs, values_of

PLAN = "image_id long, echo int, region short, merged short, wraps double, root boolean"
NAMES = [c.split()[0] for c in PLAN.split(", ")]


def plan(sizes: dict[int, int], pairs: list[tuple[int, int, float, float]]) -> dict[int, tuple[int, float, bool]]:
    """{region: (label, wraps to add, whether it was a root)} from region sizes and
    (ri, rj, offset_sum, weight_sum)."""
    label, wraps = {r: r for r in sizes}, dict.fromkeys(sizes, 0.0)
    members = {r: [r] for r in sizes}
    done: set[int] = set()
    roots: set[int] = set()
    touching = sorted((p for p in pairs if p[3] > 0), key=lambda p: (-p[3], p[1], p[0]))
    while len(done) < len(sizes):
        root = min(sizes.keys() - done, key=lambda r: (-sizes[r], r))
        done.add(root)
        roots.add(root)
        turn = [p for p in touching if p[0] in done and p[1] not in done]
        for i, j, offset, weight in turn:
            k = float(np.rint((offset / weight) / P.TWO_PI))
            if k != 0 and i != j:
                for r in members[j]:
                    wraps[r] += k
                    label[r] = i
                members[i], members[j] = members[i] + members[j], []
            done.add(j)
    return {r: (label[r], wraps[r], r in roots) for r in sizes}


def merges(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """PLAN rows from region_offsets() and region_sizes(); region 0 is none. Sizes and
    pairs come as one sorted stream, a size as a pair with region 0, so that many
    small images go to Python together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in runs(batches, [0, 1]):
            rows = list(zip(*[values_of(t, c).tolist() for c in ("ri", "rj", "offset_sum", "weight_sum")]))
            found, at = [], []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                own = plan({i: n for i, j, _, n in rows[lo:hi] if j == 0}, [p for p in rows[lo:hi] if p[1] != 0])
                found += [(r, *x) for r, x in own.items()]
                at += [lo] * len(own)
            columns = zip(*found) if found else [[]] * 4
            made = [pa.array(x, k) for x, k in zip(columns, (pa.int16(), pa.int16(), pa.float64(), pa.bool_()))]
            keys = t.select(list(KEYS)).take(pa.array(at, pa.int64())).combine_chunks()
            for lo in range(0, len(found), 65536):
                own = [c.slice(lo, 65536).combine_chunks() for c in keys.columns]
                own = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in own]
                yield pa.RecordBatch.from_arrays([*own, *[a.slice(lo, 65536) for a in made]], NAMES)

    keys = [F.col("image_id").cast("long"), F.col("echo").cast("int")]
    size = sizes.where("region <> 0").select(*keys, F.col("region").alias("ri"), F.lit(0).cast("short").alias("rj"), F.lit(0.0).alias("offset_sum"), F.col("size").alias("weight_sum"))
    both = size.unionByName(pairs.select(*keys, "ri", "rj", "offset_sum", "weight_sum"))
    return dealt(both, list(KEYS)).sortWithinPartitions(*KEYS).mapInArrow(run, PLAN)


def merge_regions(voxels: DataFrame, shape: Shape, value: str = "unwrapped") -> DataFrame:
    """voxels (with region, value and w1, w2, w3) merged: region is the label, value
    is shifted, and root says whether its own region was one."""
    found = merges(region_offsets(voxels, shape, value), region_sizes(voxels))
    df = voxels.join(found, [*KEYS, "region"], "left")
    out = {value: F.col(value) + P.TWO_PI * F.coalesce("wraps", F.lit(0.0)), "region": F.coalesce("merged", "region"), "root": F.coalesce("root", F.lit(False))}
    return df.withColumns(out).drop("merged", "wraps").select(*voxels.columns, "root")
