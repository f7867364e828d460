"""Merging on tables, growth in blocks and distributed ranks against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from unfurl.functions import phase as P
from unfurl.model import Shape
from unfurl.operators import _kernel as K
from unfurl.operators import blocks, grow, merging, ranks

TP = 2 * np.pi


@pytest.mark.parametrize("seed", range(4))
def test_merging_equals_the_kernel(spark, seed):
    """Labels, wraps and roots, with ties in size and weight and regions apart."""
    rng = np.random.default_rng(seed)
    shape = Shape(5, 4, 3)
    regions = rng.integers(0, 9, shape.size) if seed % 2 else np.repeat(np.arange(1, 7), 10)
    regions[regions == 4] = 3  # a number that no region has
    u = rng.uniform(-3, 3, shape.size) + TP * rng.integers(-2, 3, 9)[regions]
    w = rng.choice([0, 1, 50, 255], (shape.size, 3)).astype(np.uint8)
    for d in range(3):
        w[K.border((5, 4, 3), d), d] = 0
    pdf = pd.DataFrame({"image_id": 1, "echo": 1, "idx": np.arange(shape.size), "region": regions.astype(np.int16), "unwrapped": u, **{f"w{d + 1}": w[:, d].astype(np.int16) for d in range(3)}})
    got = merging.merge_regions(spark.createDataFrame(pdf).withColumns({c: F.col(c).cast("short") for c in ("region", "w1", "w2", "w3")}), shape).orderBy("idx").toPandas()
    present = sorted(set(regions.tolist()) - {0})
    dense = np.zeros(10, int)
    dense[present] = np.arange(1, len(present) + 1)
    v, merged, roots = K.merge_regions(u, dense[regions].astype(np.uint8), w, (5, 4, 3))
    assert np.allclose(got["unwrapped"], v)
    assert got["region"].tolist() == [present[m - 1] if m else 0 for m in merged]
    assert set(got.loc[got.root & (got.region > 0), "region"]) <= {present[r - 1] for r in roots}


def table(spark, phase, images=1):
    n = phase.shape[-1]
    pdf = pd.DataFrame({"image_id": np.repeat(np.arange(images), n), "echo": 1, "idx": np.tile(np.arange(n), images), "phase": phase.ravel()})
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("box,block", [((6, 5, 12), 30), ((7, 24, 1), 14), ((40, 1, 1), 5), ((6, 5, 4), 1 << 17)])
def test_blocks_equal_the_truth(spark, box, block):
    """Fields without residues, in 1 to 3 dimensions, several images of other wraps."""
    shape = Shape(*box)
    x, y, z = (np.arange(shape.size) // s % b for s, b in zip(shape.strides, box))
    truth = np.stack([0.9 * x - 1.1 * y + 0.8 * z + 0.05 * i * x for i in range(3)])
    phase = truth - TP * np.rint(truth / TP)
    got = blocks.unwrap_blocks(table(spark, phase, 3), shape, block=block).orderBy("image_id", "idx").toPandas()
    off = got["unwrapped"].to_numpy().reshape(3, -1) - truth
    assert np.allclose(off, off[:, :1]) and got.groupby("image_id")["tree"].nunique().eq(1).all()


def test_blocks_of_parts_and_gaps(spark):
    """A mask that parts an image and cuts blocks in pieces that meet elsewhere; NaN."""
    shape = Shape(8, 3, 12)
    x, y, z = (np.arange(shape.size) // s % b for s, b in zip(shape.strides, (8, 3, 12)))
    truth = 0.8 * x + 0.7 * y - 0.9 * z
    phase = truth - TP * np.rint(truth / TP)
    phase[5] = np.nan
    # A wall at x = 3 and 4 with a hole at z = 10: both sides of a block meet only there.
    mask = ~(((x == 3) | (x == 4)) & (z < 10))
    df = table(spark, phase).withColumn("x", F.col("idx") % 8).withColumn("z", F.floor(F.col("idx") / 24))
    df = df.withColumn("mask", ~(F.col("x").isin(2, 3, 4) & (F.col("z") < 10))).drop("x", "z")
    got = blocks.unwrap_blocks(df, shape, block=48).orderBy("idx").toPandas()
    off = (got["unwrapped"] - truth).to_numpy()[mask & np.isfinite(phase) & got["tree"].notna().to_numpy()]
    assert len(off) > 200 and np.allclose(off, off[0])
    rest = got["tree"].isna().to_numpy()
    assert np.allclose(got["unwrapped"].to_numpy()[rest], phase[rest], equal_nan=True)
    # Without the hole there are two trees.
    apart = df.withColumn("mask", ~(F.col("idx") % 8).isin(2, 3, 4))
    assert blocks.unwrap_blocks(apart, shape, block=48).agg(F.countDistinct("tree")).first()[0] == 2


def test_blocks_on_noise(spark):
    """Congruent always; how far growth in blocks departs from growth in one order."""
    shape = Shape(16, 16, 32)
    x, y, z = (np.arange(shape.size) // s % b for s, b in zip(shape.strides, (16, 16, 32)))
    rng, away = np.random.default_rng(3), {}
    for noise in (0.3, 0.8, 1.2):
        truth = 0.5 * x - 0.4 * y + 0.3 * z + noise * rng.standard_normal(shape.size)
        phase = truth - TP * np.rint(truth / TP)
        df = table(spark, phase)
        b = blocks.unwrap_blocks(df, shape, block=2048).orderBy("idx").toPandas()["unwrapped"].to_numpy()
        s = grow.unwrap(df, shape).orderBy("idx").toPandas()["unwrapped"].to_numpy()
        assert np.allclose((b - phase) / TP, np.rint((b - phase) / TP))
        k = np.rint((b - s) / TP)
        away[noise] = float((k != np.median(k)).mean())
    print("share of voxels apart:", away)
    assert away[0.3] == 0 and away[0.8] < 0.1


def test_forest_takes_the_heaviest(spark):
    """Against Kruskal on random graphs with distinct weights."""
    rng = np.random.default_rng(1)
    for n in (2, 9, 30):
        pairs = sorted({tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(3 * n)})
        weight = rng.permutation(len(pairs)).tolist()
        wraps = rng.integers(-3, 4, len(pairs)).tolist()
        rows = [(0, 1, a, b, k, w) for (a, b), k, w in zip(pairs, wraps, weight)]
        got = {r["node"]: (r["root"], r["wraps"]) for r in blocks.forest(spark.createDataFrame(rows, "image_id long, echo int, a long, b long, wraps long, weight long")).collect()}
        parent, tree = list(range(n)), []

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for _, _, a, b, k, w in sorted(rows, key=lambda r: -r[5]):
            if find(a) != find(b):
                parent[find(a)] = find(b)
                tree.append((a, b, k))
        for a, b, k in tree:
            assert got[a][0] == got[b][0] and got[b][1] == got[a][1] + k
        assert len({r for r, _ in got.values()}) == len({find(a) for p in pairs for a in p})


def test_ranks(spark):
    """One huge group with ties and NaN, small ones, nulls; seeds over slabs."""
    big = spark.range(60_000).select(F.lit(0).alias("g"), F.when(F.col("id") % 3 == 0, 0.5).when(F.col("id") % 1000 == 1, float("nan")).otherwise(F.rand(4)).alias("v"))
    small = spark.createDataFrame([(g, float(v)) for g in range(1, 6) for v in range(g)] + [(1, None), (9, None)], "g int, v double")
    df = big.union(small).repartition(6)
    for q in (0.0, 0.02, 0.5, 0.95, 1.0):
        want = {r[0]: r[1] for r in df.where("v is not null").groupBy("g").agg(F.percentile("v", F.lit(q))).collect()}
        got = {r[0]: r[1] for r in ranks.quantile(df, ["g"], F.col("v"), q, "x").collect()}
        assert got.keys() == want.keys() and all(got[g] == want[g] or np.isnan([got[g], want[g]]).all() for g in want)
    whole = F.rint(F.col("v") * 7)
    want = {r[0]: r[1] for r in df.where("v is not null").groupBy("g").agg(F.median(whole)).collect()}
    assert {r[0]: r[1] for r in ranks.median_of_whole(df, ["g"], whole, "x").collect()} == want
    rows = spark.range(500).select(F.lit(1).alias("g"), F.col("id").alias("idx"), ((F.col("id") * 37) % 11).alias("v"))
    got = ranks.ranks(rows, ["g"], "v", "idx", 64).orderBy("rank").collect()
    assert [r["idx"] for r in got] == sorted(range(500), key=lambda i: (i * 37 % 11, -i)) and [r["rank"] for r in got] == list(range(1, 501))
