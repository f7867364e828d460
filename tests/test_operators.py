"""DataFrame operators against the array core on small volumes with NaN, zero
magnitudes and masks, and plan shapes."""

import io
import contextlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from unfurl.model import Shape, to_volumes, to_voxels
from unfurl.operators import _kernel as K
from unfurl.operators import b0, grow, masks, offset, post, quality, regions, weights

SHAPE = Shape(5, 4, 3)


def volume(seed=0, nan=True):
    rng = np.random.default_rng(seed)
    n = SHAPE.size
    p, m = rng.uniform(-3, 3, n), rng.uniform(0, 5, n)
    m[[3, 17]] = 0
    if nan:
        p[7] = np.nan
    return pd.DataFrame(
        {"image_id": 1, "echo": 1, "idx": np.arange(n), "phase": p, "mag": m, "mask": rng.random(n) > 0.2, "phase2": rng.uniform(-3, 3, n)}
    )


@pytest.mark.parametrize("kind", ["default", "default2", "default3", "default6", "101011"])
def test_weights(spark, kind):
    pdf = volume()
    got = weights.edge_weights(spark.createDataFrame(pdf), SHAPE, kind, (4.0, 8.0)).toPandas().sort_values("idx")
    o = K.Options(weights=kind, shape=(5, 4, 3), tes=(4.0, 8.0))
    want = K.edge_weights(pdf.phase.to_numpy(), o, pdf.mag.to_numpy(), pdf["mask"].to_numpy(), pdf.phase2.to_numpy())
    assert np.array_equal(got[["w1", "w2", "w3"]].to_numpy(), want)


def test_bestpath(spark):
    pdf = volume(nan=False)
    got = weights.edge_weights(spark.createDataFrame(pdf), SHAPE, "bestpath").toPandas().sort_values("idx")
    want = K.bestpath(pdf.phase.to_numpy(), K.Options(shape=(5, 4, 3)), pdf["mask"].to_numpy())
    assert np.array_equal(got[["w1", "w2", "w3"]].to_numpy(), want)
    with pytest.raises(Exception, match="without NaN"):
        weights.edge_weights(spark.createDataFrame(volume()), SHAPE, "bestpath").collect()


def test_quality(spark):
    pdf = volume(nan=False)
    got = quality.voxel_quality(spark.createDataFrame(pdf.drop(columns=["phase2"])), SHAPE).toPandas().sort_values("idx")
    want = K.voxel_quality(pdf.phase.to_numpy(), K.Options(shape=(5, 4, 3)), pdf.mag.to_numpy(), pdf["mask"].to_numpy())
    assert np.allclose(got.quality, want, atol=1e-6, equal_nan=True)
    with pytest.raises(ValueError):
        quality.voxel_quality(spark.createDataFrame(pdf), SHAPE, "bestpath")


def test_stencil_takes_one_exchange(spark):
    df = weights.edge_weights(spark.createDataFrame(volume()).drop("mag", "mask", "phase2"), SHAPE)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    assert out.getvalue().count("Exchange") == 1


def test_unwrap_tables_agree(spark):
    pdf = pd.concat([volume(s, False).assign(image_id=s) for s in range(3)])
    vox = spark.createDataFrame(pdf).drop("phase2")
    a = grow.unwrap(vox, SHAPE).toPandas().sort_values(["image_id", "idx"])
    vols = (
        pdf.groupby("image_id")
        .agg(phase=("phase", list), mag=("mag", list), mask=("mask", list))
        .reset_index()
        .assign(echo=1, nx=5, ny=4, nz=3)
    )
    b = grow.unwrap_volumes(spark.createDataFrame(vols)).toPandas().sort_values("image_id")
    assert np.allclose(a.unwrapped.to_numpy(), np.concatenate([np.asarray(u) for u in b.unwrapped]))
    assert set(a.columns) == {"image_id", "echo", "idx", "phase", "mag", "mask", "unwrapped", "region"}


def test_multi_echo_tables_agree(spark):
    pdf = pd.concat([volume(10 + e, False).assign(echo=e, te=4.0 * e) for e in (1, 2, 3)]).drop(columns=["phase2"])
    a = grow.unwrap(spark.createDataFrame(pdf), SHAPE, multi_echo=True).toPandas().sort_values(["echo", "idx"])
    g = [x for _, x in pdf.groupby("echo")]
    u, _ = K.unwrap4d([x.phase.to_numpy() for x in g], K.Options(shape=(5, 4, 3), tes=(4.0, 8.0, 12.0)), [x.mag.to_numpy() for x in g], g[0]["mask"].to_numpy())
    assert np.allclose(a.unwrapped, np.concatenate(u))


def test_temporal_matches_kernel(spark):
    pdf = pd.concat([volume(20 + e, False).assign(echo=e, te=4.0 * e) for e in (1, 2, 3)])
    tes = [4.0, 8.0, 12.0]
    wide = post.temporal_unwrap(post.by_echo(spark.createDataFrame(pdf), 3, "phase"), tes, 2).toPandas().sort_values("idx")
    p = [x.phase.to_numpy() for _, x in pdf.groupby("echo")]
    assert np.allclose(wide.e1, K.unwrap_to(p[0], p[1] * (tes[0] / tes[1])))
    assert np.allclose(wide.e3, K.unwrap_to(p[2], p[1] * (tes[2] / tes[1])))
    fixed = post.correct_echoes(post.by_echo(spark.createDataFrame(pdf), 3, "phase"), tes).toPandas().sort_values("idx")
    assert np.allclose(fixed[["e1", "e2", "e3"]].to_numpy().T, K.correct_echoes(p, tes))


def test_corrections_and_thresholds(spark):
    pdf = volume(3).rename(columns={"phase": "unwrapped"})
    pdf["unwrapped"] += 4 * np.pi
    got = post.correct_global(spark.createDataFrame(pdf)).toPandas().sort_values("idx")
    want = pdf.unwrapped.to_numpy() - K.global_shift(pdf.unwrapped.to_numpy(), pdf["mask"].to_numpy())
    assert np.allclose(got.unwrapped, want, equal_nan=True)
    t = spark.createDataFrame([(1.0,), (-13.0,), (13.0,), (float("nan"),)], "v double")
    assert [x[0] for x in t.select(post.threshold(F.col("v"), 2.0)).collect()][:3] == [1.0, 0.0, 0.0]
    assert np.isnan(t.select(post.threshold(F.col("v"), 2.0)).collect()[3][0])
    m = spark.createDataFrame([(float("nan"), False), (2.0, True)], "v double, m boolean")
    assert [x[0] for x in m.select(post.masked(F.col("v"), F.col("m"))).collect()] == [0.0, 2.0]


def test_seed_order_and_offset(spark):
    pdf = volume(4, False)
    w = weights.edge_weights(spark.createDataFrame(pdf), SHAPE)
    got = regions.seed_order(w).toPandas().sort_values("rank")
    arr = w.toPandas().sort_values("idx")[["w1", "w2", "w3"]].to_numpy().astype(np.uint8)
    assert got.idx.tolist() == K.seed_order(arr).tolist()
    off = spark.createDataFrame(pdf).select("phase", "phase2", regions.seed_offset(F.col("phase"), F.col("phase2"), 4.0, 8.0).alias("o")).toPandas()
    for r in off.itertuples():
        assert np.isclose(r.phase + 2 * np.pi * r.o, K.corrected_seed(r.phase, r.phase2, (4.0, 8.0)))


def test_region_tables(spark):
    pdf = volume(5, False).assign(region=lambda d: (d.idx % 5 // 2).astype("int16"), w1=100, w2=0, w3=50)
    pdf["unwrapped"] = pdf.phase
    df = spark.createDataFrame(pdf)
    o = regions.region_offsets(df, SHAPE).toPandas().set_index(["ri", "rj"])
    assert np.isclose(o.loc[(1, 2)].offset_sum, -o.loc[(2, 1)].offset_sum) and 0 not in o.index.get_level_values(0)
    c = regions.correct_regions(df).toPandas()
    for r, g in c[c.region > 0].groupby("region"):
        assert abs(np.median(np.rint(g.unwrapped / (2 * np.pi)))) <= 0.5


def test_masks(spark):
    df = spark.createDataFrame(volume(6)).drop("mask")
    m = masks.robust_mask(df).toPandas()
    limit = 0.1 * np.quantile(m.mag, 0.95)
    assert ((m.mag > limit) == m["mask"]).all()
    own = spark.createDataFrame(pd.DataFrame({"image_id": 1, "idx": np.arange(60), "mask": np.arange(60) % 2}))
    assert masks.mask_from(df, own).where("mask").count() == 30
    other = own.withColumn("image_id", F.lit(99))
    assert masks.mask_from(df, own.union(other)).count() == len(m)
    larger = own.union(own.where("idx = 0").withColumn("idx", F.lit(60)))
    for wrong in (own.where("idx < 50"), own.where("idx <> 7"), larger, other):
        with pytest.raises(Exception, match="size of mask"):
            masks.mask_from(df, wrong).collect()


def test_offsets_of_images(spark):
    """Offsets that differ by channel go, so that the combined phases are the field's."""
    shape, tes = (6, 5, 4), (4.0, 8.0)
    x, y, _ = np.meshgrid(*map(np.arange, shape), indexing="ij")
    field = (0.01 * x + 0.02 * y).ravel(order="F")
    rows = []
    for image in (1, 2):
        for channel, start in ((1, 0.3 * image), (2, -1.0)):
            rows += [(image, channel, e + 1, *shape, np.angle(np.exp(1j * (start + t * field))).tolist(), None) for e, t in enumerate(tes)]
    df = spark.createDataFrame(rows, "image_id long, channel int, echo int, nx int, ny int, nz int, phase array<double>, mag array<double>").repartition(4)
    got = {(r.image_id, r.echo): r for r in offset.correct_images(df, tes, (1.0, 1.0, 1.0)).collect()}
    assert set(got) == {(i, e) for i in (1, 2) for e in (1, 2)}
    for (image, echo), r in got.items():
        assert np.allclose(r.phase, tes[echo - 1] * field, atol=1e-6) and np.allclose(r.mag, 2**0.5)
        assert np.allclose(r.offsets, [[0.3 * image] * 120, [-1.0] * 120], atol=1e-6)
    assert offset.correct_images(df.limit(0), tes, (0, 0, 0)).count() == 0
    with pytest.raises(Exception, match="same echoes"):
        offset.correct_images(df.where("channel = 1 or echo = 1"), tes, (0, 0, 0)).collect()


def test_field_map(spark):
    f = np.linspace(-50, 50, 10)
    pdf = pd.concat([pd.DataFrame({"image_id": 1, "idx": np.arange(10), "te": t, "unwrapped": 2 * np.pi * f * t / 1000, "mag": 1.0}) for t in (4.0, 8.0)])
    for kind in b0.WEIGHTINGS:
        assert np.allclose(b0.b0_map(spark.createDataFrame(pdf), kind).toPandas().sort_values("idx").b0, f)
    assert np.allclose(b0.b0_map(spark.createDataFrame(pdf.drop(columns="mag"))).toPandas().sort_values("idx").b0, f)
    with pytest.raises(ValueError):
        b0.b0_map(spark.createDataFrame(pdf), "other")


def test_offset_correction():
    shape, tes = (8, 8, 4), (4.0, 8.0, 12.0)
    x = np.arange(256) % 8
    field = 0.02 * x
    po = np.stack([np.full(256, 0.7), np.full(256, -1.1)])
    phases = np.stack([[K.wrap_full(field * t + p) for t in tes] for p in po])
    comb, mag, found = offset.correct(phases, np.ones_like(phases), tes, shape, (1.0, 1.0, 1.0))
    assert np.allclose(np.angle(np.exp(1j * (comb[0] - field * tes[0]))), 0, atol=0.05)
    assert np.allclose(mag, np.sqrt(2)) and found.shape == (2, 256)
    with pytest.raises(ValueError, match="at least 3"):
        offset.correct(phases[:, :2], np.ones((2, 2, 256)), tes[:2], shape, (1.0, 1.0, 1.0), True)


def test_volume_round_trip(spark):
    df = spark.createDataFrame([(1, 1, [0.5, float("nan"), 2.0]), (2, 1, [1.0, 2.0, 3.0])], "image_id long, echo int, phase array<double>")
    back = {r.image_id: r.phase for r in to_volumes(to_voxels(df), ["image_id", "echo"], "phase").collect()}
    assert back[2] == [1.0, 2.0, 3.0] and np.isnan(back[1][1])


def test_stream(spark, tmp_path):
    from unfurl.streaming.images import unwrap_stream

    rows = [(i, 1, 4, 1, 1, [0.1, 0.2 + 2 * np.pi, 0.3, 0.4]) for i in range(3)]
    schema = "image_id long, echo int, nx int, ny int, nz int, phase array<double>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = unwrap_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 3 and all(np.allclose(r.unwrapped, [0.1, 0.2, 0.3, 0.4]) for r in out)
