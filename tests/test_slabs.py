"""Stencils over slabs against one window over the whole image, and their plans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from unfurl.functions import phase as P
from unfurl.model import Shape
from unfurl.operators import _kernel as K
from unfurl.operators import quality, slabs, weights


def image(shape, seed, nan=0.05, images=1):
    rng = np.random.default_rng(seed)
    parts = []
    for i in range(images):
        n = shape.size
        phase = np.where(rng.random(n) < nan, np.nan, rng.uniform(-np.pi, np.pi, n))
        parts.append(pd.DataFrame({"image_id": i, "echo": 1, "idx": np.arange(n), "phase": phase, "phase2": rng.uniform(-3, 3, n), "mag": np.where(rng.random(n) < nan, np.nan, rng.random(n)), "mask": rng.random(n) > 0.2, "note": "n"}))
    return pd.concat(parts)


@pytest.mark.parametrize("box,slab", [((5, 4, 9), 8), ((3, 2, 40), 24), ((17, 1, 1), 4), ((4, 6, 1), 4), ((1, 1, 1), 4), ((6, 5, 4), 1 << 17)])
@pytest.mark.parametrize("kind", ["default", "default6", "100000", "011100"])
def test_weights_equal_the_window(spark, box, slab, kind):
    """Whatever the slabs, with gaps in phase and magnitude, and over several images."""
    shape = Shape(*box)
    df = spark.createDataFrame(image(shape, sum(box), images=2))
    got = weights.edge_weights(df, shape, kind, (1.0, 3.0), slab=slab).orderBy("image_id", "idx").toPandas()
    want = weights.qualities(df, shape, kind, (1.0, 3.0), P.quantise).orderBy("image_id", "idx").toPandas()
    for d in "123":
        assert got[f"w{d}"].tolist() == want[f"q{d}"].astype(int).tolist()
    assert got["note"].eq("n").all() and len(got) == 2 * shape.size


@pytest.mark.parametrize("slab", [8, 1 << 17])
def test_quality_and_bestpath_equal_the_kernel(spark, slab):
    shape = Shape(4, 3, 11)
    pdf = image(shape, 2, nan=0)
    df = spark.createDataFrame(pdf)
    phase, mask = pdf["phase"].to_numpy(), pdf["mask"].to_numpy()
    o = K.Options(shape=(4, 3, 11), tes=(1.0, 2.0))
    got = quality.voxel_quality(df, shape, tes=(1.0, 2.0), slab=slab).orderBy("idx").toPandas()
    want = K.voxel_quality(phase, o, pdf["mag"].to_numpy(), mask, pdf["phase2"].to_numpy())
    assert np.allclose(got["quality"], want, atol=1e-6)
    got = weights.edge_weights(df, shape, "bestpath", slab=slab).orderBy("idx").toPandas()
    assert (got[["w1", "w2", "w3"]].to_numpy() == K.bestpath(phase, o, mask)).all()


def test_large_image_is_many_tasks(spark):
    """No task gets more than its slabs with their halos; all cores get some."""
    shape = Shape(32, 32, 64)
    rows = spark.range(shape.size, numPartitions=8).select(F.lit(1).cast("long").alias("image_id"), F.lit(1).alias("echo"), F.col("id").alias("idx"), (F.rand(1) * 6 - 3).alias("phase"))
    reach, slab = 2 * 32 * 32, 8192
    halos = slabs.with_halos(rows, shape, reach, slab).groupBy("_slab").count().collect()
    assert len(halos) == 8 and max(r["count"] for r in halos) <= slab + 2 * reach
    out = weights.edge_weights(rows, shape, "100000", slab=slab)
    parts = out.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == shape.size and len(parts) > 1  # of four
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_runs_over_batches(spark):
    """Groups that begin and end within and across Arrow batches."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    shape = Shape(3, 1, 1)
    df = spark.createDataFrame(image(shape, 1, nan=0, images=40))
    want = weights.edge_weights(df, shape, "1").orderBy("image_id", "idx").collect()
    try:
        for size in (1, 2, 3, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            assert weights.edge_weights(df, shape, "1").orderBy("image_id", "idx").collect() == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_empty(spark):
    df = spark.createDataFrame(image(Shape(2), 1)).where("false")
    assert weights.edge_weights(df, Shape(2)).count() == 0


@pytest.mark.parametrize("box,slab", [((5, 4, 9), 20), ((7, 6, 1), 6), ((3, 1, 12), 3), ((6, 5, 4), 1 << 17)])
def test_smoothing_equals_the_kernel(spark, box, slab):
    from unfurl.operators import offset

    shape, rng = Shape(*box), np.random.default_rng(sum(box))
    z = rng.normal(size=(2, shape.size)) + 1j * rng.normal(size=(2, shape.size))
    pdf = pd.concat([pd.DataFrame({"image_id": i, "idx": np.arange(shape.size), "re": x.real, "im": x.imag, "note": "n"}) for i, x in enumerate(z)])
    for sigma in ((1.0, 0.7, 1.3), (0.0, 2.0, 0.0), (0.5, 0.0, 4.0)):
        got = offset.smooth_voxels(spark.createDataFrame(pdf), shape, sigma, slab=slab).orderBy("image_id", "idx").toPandas()
        want = np.concatenate([offset.smooth(x, box, sigma) for x in z])
        assert np.allclose(got["re"] + 1j * got["im"], want) and got["note"].eq("n").all()


def test_channel_offsets(spark):
    """Offsets of a smooth field as the kernel estimates them."""
    from unfurl.operators import offset

    shape, tes, sigma = Shape(6, 5, 4), (2.0, 5.0), (1.0, 1.0, 0.8)
    x, y, z = (np.arange(shape.size) // s % b for s, b in zip(shape.strides, (6, 5, 4)))
    field = 0.12 * x - 0.1 * y + 0.15 * z
    phases = np.stack([[te * field + (c + 1) * 0.3 + 0.05 * c * x for te in tes] for c in range(2)])
    phases = phases - 2 * np.pi * np.rint(phases / (2 * np.pi))
    mags = 1 + 0.1 * np.random.default_rng(1).random(phases.shape)
    rows = [(1, c + 1, e + 1, i, float(phases[c, e, i]), float(mags[c, e, i])) for c in range(2) for e in range(2) for i in range(shape.size)]
    v = spark.createDataFrame(rows, "image_id long, channel int, echo int, idx long, phase double, mag double")
    got = offset.channel_offsets(v, shape, tes, sigma, slab=60).orderBy("channel", "idx").toPandas()["offset"].to_numpy()
    _, _, want = offset.correct(phases, mags, tes, (6, 5, 4), sigma)
    away = (got - want.ravel()) / (2 * np.pi)
    assert np.allclose(away, np.rint(away), atol=1e-9)
